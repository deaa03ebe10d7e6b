"""stemfield: a Spark-native engine for forest point clouds and text corpora."""

__version__ = "0.1.0"
