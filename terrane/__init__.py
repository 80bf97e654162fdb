"""terrane: a PySpark-native engine for versioned tabular research data."""
