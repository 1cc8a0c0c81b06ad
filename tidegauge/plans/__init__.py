"""plans of tidegauge."""
