"""Analytics for question-and-answer community data, as Spark DataFrame jobs."""
