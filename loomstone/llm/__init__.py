"""Training-data operators.  Optional: nothing outside imports this package."""
