"""loomlog: coding-assistant transcript analytics and corpus preparation on PySpark."""
