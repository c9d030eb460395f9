"""DataFrame operators on interaction tables."""
