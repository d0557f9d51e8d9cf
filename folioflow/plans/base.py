"""What the registered queries share: the registry, and the derived tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Derived tables as common table expressions; the same rules as in sources.derived.
SQL = {
    "raw": "raw AS (SELECT doc_id, seq, str, (seq // 600)::INT AS page, CASE WHEN seq % 600 < 12 THEN 18.0::DOUBLE ELSE 12.0::DOUBLE END AS sz, seq % 50 IN (7, 8) AS flat FROM (SELECT doc_id, unnest(range(len(t)))::BIGINT AS seq, unnest(t) AS str FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)))",
    "items": "items AS (SELECT doc_id, page, seq, str, CASE WHEN flat THEN (CASE WHEN seq % 50 = 8 THEN 12.0 ELSE sz END) ELSE sz END AS size, (72 + seq % 12 * 40)::DOUBLE AS x, (720 - (seq % 600) // 12 * 14)::DOUBLE AS y, (5 * length(str))::DOUBLE AS w, CASE WHEN flat THEN 0.0 ELSE sz END AS a, CASE WHEN (seq // 12) % 7 = 0 THEN 'ABCDEF+Serif-Bold' ELSE 'Serif' END AS font FROM raw WHERE regexp_matches(str, '[^ \\n]'))",
    "pages": "pgs AS (SELECT DISTINCT doc_id, page, 612.0::DOUBLE AS page_width, 792.0::DOUBLE AS page_height FROM items)",
    "red": "red AS (SELECT doc_id, page, (72 + doc_id % 12 * 40)::DOUBLE AS rx, (72 + (doc_id + page) % 40 * 14)::DOUBLE AS ry_down, 80.0::DOUBLE AS rw, 28.0::DOUBLE AS rh FROM pgs)",
    "rules": "rules AS (SELECT doc_id, page, 70.0::DOUBLE AS x, (730 - 14 * k)::DOUBLE AS y, 480.0::DOUBLE AS w, 1.0::DOUBLE AS h FROM pgs, range(51) r(k) WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, page, (70 + 40 * (k // 2) + k % 2)::DOUBLE, 30.0, 1.0, 700.0 FROM pgs, range(26) r(k) WHERE doc_id % 5 = 0)",
    "links": "links AS (SELECT doc_id, page, k AS ord, 'https://example.com/' || doc_id || '/' || k AS url, (72 + 40 * ((doc_id + 3 * k) % 10))::DOUBLE AS lx, (716 - 14 * ((page + k // 2) % 8))::DOUBLE AS ly, 95.0::DOUBLE AS lw, 14.0::DOUBLE AS lh FROM pgs, range(3) r(k))",
    "paras": "paras AS (SELECT doc_id, n AS ord, (n // 20)::INT AS page, text, (780 - 39 * (n % 20))::DOUBLE AS y, CASE WHEN n % 20 = 1 THEN 20.0 WHEN n % 7 = 3 THEN 14.0 ELSE 10.0 END::DOUBLE AS size FROM (SELECT doc_id, unnest(range(len(t)))::BIGINT AS n, unnest(t) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))",
    "marked": "marked AS (SELECT doc_id, ord, page, y, size, CASE ord % 5 WHEN 0 THEN '• ' WHEN 1 THEN ord || '. ' WHEN 2 THEN '(' || chr((97 + ord % 26)::INT) || ') ' WHEN 3 THEN '(iv) ' ELSE '' END || text AS text FROM paras)",
    "man": "man AS (SELECT o_custkey AS source_id, o_orderkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, (o_orderkey % 4 * 90)::INT AS rotation FROM orders)",
}
_NEEDS = {"items": ["raw"], "pages": ["raw", "items"], "red": ["raw", "items", "pages"], "rules": ["raw", "items", "pages"], "links": ["raw", "items", "pages"], "marked": ["paras"]}


def with_tables(*names: str) -> str:
    """WITH and the derived tables, each after what it needs, and a comma for more."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(SQL[n] for n in order)


class Registry:
    """Queries by name, with their SQL where there is any."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
