"""sources of kerfspark."""
