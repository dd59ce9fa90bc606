"""Spark-native engine that turns scientific documents into a table of dataset citations."""
