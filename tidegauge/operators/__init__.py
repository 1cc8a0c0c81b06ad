"""operators of tidegauge."""
