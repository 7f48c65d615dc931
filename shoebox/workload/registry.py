"""Registered queries: each reads the test tables through the roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import Roles, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, roles: tuple[str, ...] = ()):
    """Register ``fn(roles) -> DataFrame`` with its SQL twin, if there is one."""

    def register(fn: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Roles(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_roles(sql, roles)
        return fn

    return register


def tree_sql(rows: str) -> str:
    """The root of the digest tree over the hashes ``h`` that ``rows`` selects."""
    nodes = f"SELECT h, h||':'||count(*) AS t FROM ({rows}) GROUP BY h"
    for digits in (12, 8, 4, 0):
        joined = "sha256(string_agg(t, chr(10) ORDER BY t))"
        nodes = f"SELECT p AS h, p||'='||{joined} AS t, {joined} AS d FROM (SELECT substr(h,1,{digits}) AS p, t FROM ({nodes})) GROUP BY p"
    return f"SELECT d FROM ({nodes})"
