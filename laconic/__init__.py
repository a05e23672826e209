"""laconic: a Spark-native engine that shortens text corpora for language models."""

__version__ = "0.1.0"
