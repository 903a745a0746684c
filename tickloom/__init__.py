"""tickloom: market-data analytics as DataFrame -> DataFrame operators on Spark."""
