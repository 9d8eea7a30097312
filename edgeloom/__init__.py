"""edgeloom: a Spark-native analytics engine for time series with a graph model."""

__version__ = "0.1.0"
