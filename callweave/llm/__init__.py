"""Training-data operators on Spark: ten operators for large text corpora and their queries."""
