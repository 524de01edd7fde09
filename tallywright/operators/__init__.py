"""Building blocks that the reports and the loader share."""
