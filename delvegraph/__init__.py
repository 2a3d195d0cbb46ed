"""delvegraph: code-intelligence analytics as PySpark DataFrame plans."""
