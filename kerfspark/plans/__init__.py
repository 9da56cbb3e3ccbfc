"""plans of kerfspark."""
