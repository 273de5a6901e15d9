"""Spark-first document analytics: chunking, retrieval, grounding, evaluation."""
