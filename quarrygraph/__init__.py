"""Spark-first analytics engine: C source knowledge graphs and the relational operators around them."""
