"""Rules, resolvers and reports over fact tables; every function takes and returns DataFrames."""
