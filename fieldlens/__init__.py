"""Camera-trap data engine: DataFrame-to-DataFrame functions on Spark."""
