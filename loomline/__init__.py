"""Loomline: a PySpark-native engine for long-form text, spoken-word timelines and corpus preparation."""
