"""gridproof: verification of gridded forecasts as PySpark DataFrame jobs."""
