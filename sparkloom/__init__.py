"""A join-centred analytics engine on Spark's DataFrame, SQL and adaptive execution."""
