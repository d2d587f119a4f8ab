"""Registry of demonstration queries and their plain-SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The canonical views in SQL, the same expressions as etholith.views.
SQL_VIEWS = {
    "bouts": """SELECT event_id AS ord, user_id AS animal_id,
        CASE WHEN event_id % 2 = 0 THEN 'S1' ELSE 'S2' END AS session_type,
        event_type || '_' || CAST(k % 4 AS VARCHAR) AS behavior,
        CASE k % 3 WHEN 0 THEN 'exp' WHEN 1 THEN 'stim' END AS actor,
        sec AS start_sec, sec + value AS end_sec, value AS duration_sec
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                     (epoch_us(ts) - 1704067200000000) / 1e6 AS sec FROM events)""",
    "runs": """SELECT event_id AS ord, user_id % 20 AS animal_id,
        CAST(floor(sec / 3600) AS BIGINT) AS frame_id, 1 + event_id % 2 AS obj_id,
        CASE event_type WHEN 'click' THEN 'output' WHEN 'view' THEN 'resume' WHEN 'signup' THEN 'resume2'
             WHEN 'purchase' THEN 'resume3' WHEN 'error' THEN 'output' END AS run_name,
        value AS x, CAST(k AS DOUBLE) AS y
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                     (epoch_us(ts) - 1704067200000000) / 1e6 AS sec FROM events)""",
    "points": """SELECT l_suppkey AS image_id,
        CASE l_returnflag WHEN 'A' THEN 'GFP' WHEN 'R' THEN 'cFOS' ELSE 'both' END AS marker,
        (l_orderkey * 7919 + l_linenumber * 31) % 512 AS x,
        (l_partkey * 104729 + l_linenumber * 17) % 512 AS y,
        l_orderkey * 10 + l_linenumber AS ord, l_quantity AS area,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem""",
    "kpts": """SELECT l_orderkey % 4 AS video_id, l_orderkey AS frame_id, l_linenumber AS joint, 's1' AS subject,
        CASE WHEN l_quantity >= 2 THEN CAST((l_orderkey * 37) % 512 + l_linenumber * 10 + l_partkey % 41 - 20 AS DOUBLE) END AS x,
        CASE WHEN l_quantity >= 2 THEN CAST((l_orderkey * 53) % 512 + l_linenumber * 7 + l_suppkey % 31 - 15 AS DOUBLE) END AS y,
        1 - 5 * l_discount AS likelihood, l_partkey, l_suppkey, l_extendedprice FROM lineitem
        UNION ALL
        SELECT l_orderkey % 4, l_orderkey, l_linenumber, 's2',
        CASE WHEN l_quantity >= 2 THEN CAST((l_orderkey * 37) % 512 + l_linenumber * 10 + l_suppkey % 61 - 30 + 60 AS DOUBLE) END,
        CASE WHEN l_quantity >= 2 THEN CAST((l_orderkey * 53) % 512 + l_linenumber * 7 + l_partkey % 31 - 15 AS DOUBLE) END,
        1 - 5 * l_tax, l_partkey, l_suppkey, l_extendedprice FROM lineitem""",
    "counts": """SELECT o_orderkey AS image_id, o_custkey AS animal_id, o_orderpriority AS cohort, o_totalprice AS ref_total,
        manual_total, auto_total, a_only, b_only, both_n, n_lines
        FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS manual_total,
          sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS auto_total,
          sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS a_only,
          sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS b_only,
          sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END) AS both_n,
          count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "files": """SELECT c_custkey AS ord,
        CASE WHEN c_custkey % 11 = 0 THEN 'stray' WHEN c_custkey % 3 = 0 THEN 'Count' ELSE 'count' END
        || CAST(c_custkey % 50 AS VARCHAR) || '_' || CAST(c_custkey % 7 AS VARCHAR)
        || CASE c_nationkey % 4 WHEN 0 THEN '_LVCC_RAW_final.tif' WHEN 1 THEN '_GFPseg.tif'
                WHEN 2 THEN '_cFOSseg.tif' ELSE '.tif' END AS name FROM customer""",
    "tiles": """SELECT CAST(label AS BIGINT) AS stack, vec_id AS z,
        list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INTEGER)) AS pixels
        FROM embeddings""",
    "masks": """SELECT vec_id, label, vec_id // 2 AS slot, 1 + vec_id % 2 AS obj_id,
        list_filter(range(64), lambda i: embedding[i + 1] > 0) AS px FROM embeddings""",
}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` and, if given, its SQL over the named views."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views.split())
            body = sql.strip()
            if not ctes:
                ORACLES[name] = body
            elif body.upper().startswith("WITH RECURSIVE "):
                ORACLES[name] = f"WITH RECURSIVE {ctes}, {body[15:]}"
            elif body.upper().startswith("WITH "):
                ORACLES[name] = f"WITH {ctes}, {body[5:]}"
            else:
                ORACLES[name] = f"WITH {ctes} {body}"
        return fn

    return keep


def rd(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the offset keeps decimal half-way values off the rounding edge."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(0.0314159265 * 10.0**-digits), digits) + F.lit(0.0)


def R(expr: str, digits: int = 6) -> str:
    """The SQL form of :func:`rd`."""
    return f"(round(CAST({expr} AS DOUBLE) + {0.0314159265 * 10.0**-digits!r}, {digits}) + 0.0)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rd(c, digits) for c in cols})
