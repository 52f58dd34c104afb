"""leafmill: document-library analytics expressed as Spark DataFrames."""
