"""lexspan: temporal document-corpus analytics as Spark DataFrame jobs."""
