"""factmill: typed fact graphs of source code and other records, as Spark DataFrames."""
