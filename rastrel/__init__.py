"""rastrel: raster images as pixel tables, traced and measured with Spark."""
