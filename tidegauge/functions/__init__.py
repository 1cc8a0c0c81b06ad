"""functions of tidegauge."""
