"""functions of kerfspark."""
