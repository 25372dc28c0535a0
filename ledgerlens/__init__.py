"""Analytics of directed money-transfer networks on Spark."""
