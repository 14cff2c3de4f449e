"""Gridded terrain analytics and corpus preparation, expressed as Spark plans."""
