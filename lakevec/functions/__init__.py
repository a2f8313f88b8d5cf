"""Column functions, JVM-side wherever Catalyst can express them."""
