"""Contract-document analytics expressed as PySpark DataFrame operators."""
