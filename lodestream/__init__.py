"""lodestream: a Spark-native analytics engine over transcripts, usage events and documents."""
