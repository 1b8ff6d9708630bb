"""The analysis functions, by kind; ``registry`` has them by name."""
