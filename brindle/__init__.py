"""brindle: a Spark-first analytical SQL engine."""
