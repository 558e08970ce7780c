"""Usage analytics over append-only logs, written as Spark DataFrame plans."""
