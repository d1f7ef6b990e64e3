"""hourline: DataFrame-to-DataFrame operators for large collections of time series on Spark."""
