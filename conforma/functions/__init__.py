"""Column expressions: text predicates, colour arithmetic, slide geometry."""
