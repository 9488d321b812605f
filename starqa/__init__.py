"""Question answering over star-schema tables, as Spark jobs."""
