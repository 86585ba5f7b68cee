"""Named queries over a table folder, with their SQL counterparts."""
