"""Document-conformance analytics on Spark: rules, resolvers and reports as DataFrames."""
