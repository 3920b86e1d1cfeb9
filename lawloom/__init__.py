"""lawloom: analytics over versioned document corpora, built on Spark SQL and DataFrames."""
