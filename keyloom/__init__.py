"""keyloom: perfect hashing and compact key indexes on Spark DataFrames."""
