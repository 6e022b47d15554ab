"""A PySpark-native analytics engine for quarterly institutional-holdings disclosures."""
