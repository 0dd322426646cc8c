"""Free-space analytics on Spark: sphere maps, segments, paths and map messages as DataFrame operators."""
