"""DataFrame operators on named axes."""
