"""Load-series analytics on Spark: resampling, features, diagnostics and model datasets as DataFrame transforms."""
