"""rankloom: document ranking and entity analytics as PySpark DataFrame operators."""
