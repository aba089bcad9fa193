"""tidemark: analytics over tables and training-data preparation, written as Spark DataFrame jobs."""
