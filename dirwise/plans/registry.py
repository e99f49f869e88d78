"""Where query adapters register themselves together with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dirwise.plans.fixtures import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names the shared input views of its SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ctes = ", ".join(f"{u} AS ({CTES[u]})" for u in uses)
            body = sql.strip()
            if ctes and body[:15].upper() == "WITH RECURSIVE ":
                body = "WITH RECURSIVE " + ctes + ", " + body[15:]
            elif ctes and body[:5].upper() == "WITH ":
                body = "WITH " + ctes + ", " + body[5:]
            elif ctes:
                body = "WITH " + ctes + " " + body
            ORACLES[name] = body
        return fn

    return wrap
