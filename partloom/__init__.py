"""Spark-native enrichment and evaluation of product part catalogs."""
