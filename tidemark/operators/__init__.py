"""Row and table operators: transforms, as-of joins, merging of sources."""
