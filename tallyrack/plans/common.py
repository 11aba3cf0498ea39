"""How queries and their SQL are put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import SIMPLE, SIMPLE_PARTS
from .fixtures import with_views


class Book:
    """Queries of one family: ``@book(name, views, sql)`` registers a query and its oracle."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, views: str = "", sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                head = with_views(*views.split())
                self.oracles[name] = head + (", " + sql.strip()[5:] if head and sql.strip().upper().startswith("WITH ") else sql)
            return f

        return add


def micros(c: str):
    return F.unix_micros(F.col(c)).alias(f"{c}_us")


def r6(c):
    return F.round(c, 6)


def lit(x) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x).lower() if isinstance(x, bool) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)


def values(rows) -> str:
    return ", ".join(f"({', '.join(map(lit, r))})" for r in rows)


def simple_ctes(seconds: int) -> str:
    """Common tables from samples ``s`` (jid, host, time, ncores, nhosts, type, event, value, arc) to ``simple`` (jid, type, metric, value) and ``units``."""
    after_first = lambda by: f"WHERE r > 1 OR n = 1 GROUP BY {by}, host"
    return f"""spec(metric, attempt, part, type, event, factor, gauge, nonneg, most, positive) AS (VALUES {values(SIMPLE_PARTS)}),
  sx AS (SELECT jid, metric, attempt, part, type, gauge, factor, positive, host, time, sum(CASE WHEN NOT (nonneg AND arc < 0) THEN arc END) AS a, sum(v) AS v, count(v) AS c
        FROM (SELECT s.*, metric, attempt, part, gauge, factor, nonneg, positive, CASE WHEN gauge AND value < 140737488355328 AND coalesce(value * factor <= most, true) THEN value * factor END AS v FROM s JOIN spec USING (type, event)) GROUP BY ALL),
  sb AS (SELECT jid, metric, attempt, part, type, positive, host, floor(epoch(time) / {seconds}) AS b, sum(CASE WHEN gauge THEN v ELSE coalesce(a, 0) * factor END) / sum(CASE WHEN gauge THEN c ELSE 1 END) AS v FROM sx WHERE NOT gauge OR c > 0 GROUP BY ALL),
  sh AS (SELECT jid, metric, attempt, part, type, positive, avg(v) AS v FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY jid, metric, attempt, part, type, host) AS n FROM sb WINDOW w AS (PARTITION BY jid, metric, attempt, part, type, host ORDER BY b)) {after_first("jid, metric, attempt, part, type, positive")}),
  sp AS (SELECT jid, metric, attempt, part, type, positive, avg(v) AS v FROM sh GROUP BY ALL), st AS (SELECT jid, metric, attempt, positive, sum(v) AS value, arg_min(type, part) AS type FROM sp GROUP BY 1, 2, 3, 4),
  sd AS (SELECT jid, metric, arg_min(type, attempt) AS type, arg_min(value, attempt) AS value FROM st WHERE value > 0 OR NOT positive GROUP BY 1, 2),
  su AS (SELECT jid, host, time, ncores, nhosts, sum(arc) FILTER (event IN ('user', 'system', 'nice')) AS b, sum(arc) FILTER (event IN ('idle', 'iowait', 'irq', 'softirq')) AS i FROM s WHERE type = 'host_cpu' GROUP BY ALL HAVING b IS NOT NULL OR i IS NOT NULL),
  sc AS (SELECT jid, host, floor(epoch(time) / {seconds}) AS b, avg(CASE WHEN i IS NULL THEN coalesce(b, 0) * 0.01::DOUBLE WHEN coalesce(b, 0) + i = 0 THEN 0 ELSE least(greatest(coalesce(b, 0) / (coalesce(b, 0) + i), 0), 1) * ncores / nhosts END) AS v FROM su GROUP BY ALL),
  cpu AS (SELECT jid, sum(v) AS value FROM (SELECT jid, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY jid, host ORDER BY b) AS r, count(*) OVER (PARTITION BY jid, host) AS n FROM sc) {after_first("jid")}) GROUP BY jid),
  sw AS (SELECT jid, max(value) FILTER (metric = 'avg_ibbw') AS b, max(type) FILTER (metric = 'avg_ibbw') AS type, max(value) FILTER (metric = 'avg_flops') AS f, max(value) FILTER (metric = 'avg_tensor_active') AS t FROM sd GROUP BY jid),
  units(metric, units) AS (VALUES {values((k, u) for k, (_, u) in SIMPLE.items())}),
  simple AS (SELECT * FROM (SELECT jid, type, metric, value FROM sd UNION ALL SELECT jid, 'host_cpu', 'avg_cpuusage', value FROM cpu UNION ALL SELECT jid, type, 'avg_fabric_mb_per_gflops', b / f FROM sw WHERE f > 0 AND b >= 0
    UNION ALL SELECT jid, type, 'avg_fabric_mb_per_avg_tensor', b / (t / 100) FROM sw WHERE t > 0.000001 AND b >= 0) WHERE value IS NOT NULL)"""
