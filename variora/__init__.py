"""A Spark-native engine for annotated, parallel text corpora."""
