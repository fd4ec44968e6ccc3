"""Named queries, each next to its SQL counterpart."""
