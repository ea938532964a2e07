"""Document analytics and retrieval on Spark: line labelling, chunking, ranking, extraction, evaluation."""
