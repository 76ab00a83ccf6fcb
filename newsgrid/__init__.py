"""newsgrid: news-event analytics as Spark DataFrame jobs."""
