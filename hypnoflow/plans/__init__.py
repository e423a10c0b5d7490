"""Named queries with their SQL counterparts."""
