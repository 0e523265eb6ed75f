"""tidemark: point-in-time panel analytics as PySpark DataFrame plans."""
