"""Multi-resolution spatial maps from streams of classified points, on Spark DataFrames."""
