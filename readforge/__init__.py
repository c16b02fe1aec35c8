"""readforge: sequencing-quality analytics on PySpark."""
