"""Portfolio analytics as Spark plans."""
