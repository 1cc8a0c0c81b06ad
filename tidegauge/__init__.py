"""tidegauge: a PySpark-native engine for dated-event question-answer data sets."""

__version__ = "0.1.0"
