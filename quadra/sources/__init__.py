"""Readers and writers: shapefiles and GeoParquet. Everything else is Spark's own."""
