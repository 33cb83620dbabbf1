"""Access-graph analytics as plain PySpark DataFrame programs."""
