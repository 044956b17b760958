"""fathom: a PySpark-native engine for engineering memory and code intelligence."""

__version__ = "0.1.0"
