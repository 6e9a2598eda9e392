"""pagescope: a PySpark-native analytics engine for website AI-readiness."""

__version__ = "0.1.0"
