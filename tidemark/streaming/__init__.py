"""Event-time windows on batch frames and on streams."""
