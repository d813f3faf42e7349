"""DataFrame-to-DataFrame operators for panel data."""
