"""riverlens — Spark-native sensor-quality and survey analytics.

Every operator takes and returns a pyspark DataFrame (or a Column); the
heavy lifting is left to Catalyst: windows, aggregates, joins and pivots.
"""

__version__ = "0.1.0"
