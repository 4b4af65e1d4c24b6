"""Spark-native analytics for cohorts of aligned sequences."""
