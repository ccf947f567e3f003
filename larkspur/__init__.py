"""A Spark-native analytics engine for click logs, recommendation slates and their evaluation."""
