"""factloom: a PySpark-native analytics engine for text-credibility data."""
