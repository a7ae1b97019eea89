"""Analytics over infrastructure-project records, as Spark DataFrame operators."""
