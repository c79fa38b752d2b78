"""thermoscope — Spark-native sweep, feature and regression analytics.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame operators), ``plans`` (composed jobs
and the query catalog), ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
