"""siltwork: text retrieval, evaluation and corpus preparation on Spark DataFrames."""
