"""Evidence-backed candidate ranking and text data processing on Spark."""
