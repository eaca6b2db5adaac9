"""Spark-native news-risk analytics: text feeds to signals, signals to portfolio risk."""
