"""Cross-lingual topic analytics expressed as Spark DataFrame operators."""
