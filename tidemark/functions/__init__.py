"""Column functions and aggregate bundles."""
