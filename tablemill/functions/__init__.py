"""Column expressions; none of them touches rows outside Spark's own operators."""
