"""Spark-native analytics over modular code bases and over plain tables."""
