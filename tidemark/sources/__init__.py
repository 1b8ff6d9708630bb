"""Source adapters: each turns a query into a DataFrame; ``registry`` routes by type."""
