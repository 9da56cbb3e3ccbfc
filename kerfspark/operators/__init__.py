"""operators of kerfspark."""
