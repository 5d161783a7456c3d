"""Training-data operators: decontamination, packing, language ID, PII, quality, toxicity,
language-model scoring, licence scans, near-duplicate join and substring deduplication.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when present.
"""
