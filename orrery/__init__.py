"""orrery: a Spark-first analytics engine for code graphs and text corpora."""
