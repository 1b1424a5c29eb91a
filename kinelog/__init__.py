"""kinelog: trajectory analytics and corpus preparation as Spark jobs."""
