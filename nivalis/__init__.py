"""Station, grid and forecast analytics as Spark DataFrame operators."""
