"""streaming of kerfspark."""
