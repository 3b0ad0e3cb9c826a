"""formweave: a PySpark-native engine for form, profile and document data."""
