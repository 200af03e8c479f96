"""Query registry: each query with its SQL twin, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Views of the driver tables in DuckDB, as in sources.views.
VIEWS = {
    "trials": """trials AS (SELECT vec_id % 10 AS participant, label AS condition, vec_id AS epoch, CAST(p AS INTEGER) AS pos, (p - 1) / 64.0::DOUBLE AS time,
        CAST(embedding[p] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(p))""",
    "recording": """recording AS (SELECT user_id AS participant, row_number() OVER w AS sample, CAST(row_number() OVER w - 1 AS DOUBLE) AS time,
        CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS BIGINT) AS triggers, value
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
    "multich": """multich AS (SELECT l_suppkey % 10 AS participant, l_returnflag || l_linestatus AS condition, l_orderkey AS epoch,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS pos,
        l_quantity AS Q, l_extendedprice AS P, l_discount AS D, l_tax AS T FROM lineitem)""",
    "erp": """erp AS (SELECT participant, condition, pos, min(time) AS time, avg(value) AS value, count(*) AS n_epochs FROM trials GROUP BY participant, condition, pos)""",
    "merp": """merp AS (SELECT participant, condition, pos, CAST(pos AS DOUBLE) AS time, avg(Q) AS Q, avg(P) AS P, avg(D) AS D, avg(T) AS T, count(*) AS n_epochs
        FROM multich GROUP BY participant, condition, pos)""",
}
NEEDS = {"erp": ("trials",), "merp": ("multich",)}


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds doubles so that both engines agree, and turns -0.0 into 0.0."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def query(sql: str | None = None, views: str = ""):
    """Registers a function (spark, sf_dir) under its name; `views` are put before the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            names: list[str] = []
            for v in views.split():
                names += [x for x in (*NEEDS.get(v, ()), v) if x not in names]
            text = sql.strip()
            if names:
                head = ",\n".join(VIEWS[v] for v in names)
                text = f"WITH {head},\n{text[5:]}" if text[:5].upper() == "WITH " else f"WITH {head}\n{text}"
            ORACLES[f.__name__] = text
        return f

    return add
