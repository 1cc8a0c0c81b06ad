"""streaming of tidegauge."""
