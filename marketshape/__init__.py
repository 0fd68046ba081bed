"""marketshape: topology of co-moving time series on Spark, with the cleaning
operators a large training-data pipeline needs in front of it."""
