"""Earth-observation evidence for agriculture, as PySpark DataFrame operators."""
