"""barlab: market-bar analytics as Spark DataFrame operators."""
