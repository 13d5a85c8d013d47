"""Packaged-goods label compliance analytics as Spark jobs."""
