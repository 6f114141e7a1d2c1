"""Point, observation and raster analytics expressed as Spark DataFrame jobs."""
