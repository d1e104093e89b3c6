"""Cardwright: a Spark-native engine for catalogue quality control."""
