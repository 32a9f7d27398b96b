"""trailhead: Spark-native context retrieval and feedback analytics over large text and source corpora."""

__version__ = "0.1.0"
