"""Roadside video analytics and training-data operators as Spark jobs."""
