"""tidewright: a Spark-native engine for event studies and data pipelines on irregular daily series."""

__version__ = "0.1.0"
