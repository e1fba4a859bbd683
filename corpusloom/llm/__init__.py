"""Training-data operators: ten Spark jobs over a table of documents."""
