"""File sources and the append-only run tables."""
