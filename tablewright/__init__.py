"""tablewright: a Spark-native engine for tables extracted from financial disclosures."""
