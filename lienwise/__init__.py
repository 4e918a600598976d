"""Risk analytics for delegated payments on Spark."""
