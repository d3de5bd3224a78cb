"""landloom: raster land-use analytics as Spark DataFrames keyed by cell coordinates."""

__version__ = "0.1.0"
