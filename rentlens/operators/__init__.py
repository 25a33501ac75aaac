"""Building blocks the plans are composed of."""
