"""Portfolio ledgers, price metrics and decision outcomes as Spark DataFrame operators."""
