"""DataFrame operators on long series tables."""
