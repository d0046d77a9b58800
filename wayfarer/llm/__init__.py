"""Training-data operators: text, vector and page jobs that run as Spark stages."""
