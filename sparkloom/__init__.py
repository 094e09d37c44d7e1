"""sparkloom: data operators for tables and streams, each a function from DataFrames to DataFrames on Spark."""
