"""Time-series and portfolio analytics as PySpark DataFrame plans."""
