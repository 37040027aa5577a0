"""Delay and crowding analytics over public-transport event data, as Spark jobs."""
