"""All registered queries."""

from findling.plans import evidence, loading, queries, shows, stores

__all__ = ["evidence", "loading", "queries", "shows", "stores"]
