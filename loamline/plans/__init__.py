"""The registered queries, the feed they run on, and their SQL counterparts."""
