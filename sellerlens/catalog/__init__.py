"""All registered queries."""

from __future__ import annotations

from functools import cache

from sellerlens.catalog.registry import Registry


@cache
def registry() -> Registry:
    from sellerlens.catalog import article_queries, feed_queries, landed_queries

    r = Registry()
    article_queries.add_to(r)
    feed_queries.add_to(r)
    landed_queries.add_to(r)
    return r
