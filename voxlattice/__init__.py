"""Spark-native analysis of image volumes, node fields and the text corpora beside them."""
