"""sources of tidegauge."""
