"""tillscope: retail transaction analytics as Spark DataFrame operators."""
