"""Order-book and tick analytics as Spark DataFrame operators."""
