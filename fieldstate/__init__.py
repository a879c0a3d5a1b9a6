"""Daily field state from fixed-camera image classifications, on Spark DataFrames."""
