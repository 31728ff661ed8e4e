"""Catalog relations derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from lodestack.functions.dims import ASSET_TYPES
from pyspark.sql import DataFrame, SparkSession


def _case(value: str, names: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(names)) + " END"


_TYPE = _case("(l_linenumber + l_suppkey) % 20", [t for t, _ in ASSET_TYPES])
_REGION = _case("p_size % 7", ["USA", "Europe", "Japan", "World", "USA, Europe", "Germany", "Unknown"])
_STATE = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'parked' ELSE 'done' END"
_REVIEW = "CASE o_orderpriority WHEN '1-URGENT' THEN 'pending' WHEN '2-HIGH' THEN 'deferred' WHEN '3-MEDIUM' THEN 'accepted' WHEN '4-NOT SPECIFIED' THEN 'rejected' ELSE 'superseded' END"

SQL = {
    "release_editions": f"""SELECT p_partkey AS id, game AS game_id, p_name AS title,
        CASE p_type WHEN 'ECONOMY' THEN 'Nintendo - Game Boy' WHEN 'LARGE' THEN 'Sony - PlayStation' WHEN 'MEDIUM' THEN 'Sony - PlayStation 2'
          WHEN 'PROMO' THEN 'Nintendo - Nintendo DS' WHEN 'SMALL' THEN 'MAME' ELSE 'Other (Digital)' END AS platform,
        {_REGION} AS region, CASE WHEN p_size % 3 = 0 THEN 'Standard' ELSE p_brand END AS edition FROM part JOIN (SELECT p_name AS named, min(p_partkey) AS game FROM part GROUP BY p_name) ON named = p_name""",
    "assets": f"""SELECT l_partkey AS release_id, {_TYPE} AS asset_type, l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3,
        md5('o' || cast((l_partkey * 31 + l_suppkey) % 5000 AS STRING)) AS object_hash,
        cast(round(l_extendedprice * 100) AS BIGINT) AS byte_len,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE cast(l_quantity AS BIGINT) * 16 END AS width,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE cast(l_quantity AS BIGINT) * 9 END AS height,
        'src' || cast(l_suppkey % 9 AS STRING) AS source_id,
        CASE l_suppkey % 5 WHEN 0 THEN 'scan ' || cast(l_linenumber AS STRING) || '.PNG' WHEN 1 THEN 'cover' WHEN 2 THEN 'a:b?c.jpeg' WHEN 3 THEN 'con.tif' ELSE 'cover. ' END AS original_filename,
        CASE l_linenumber % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END AS media_type FROM lineitem""",
    "work": f"""SELECT o_custkey AS run_id, o_orderkey AS work_id, {_STATE} AS state, {_REVIEW} AS review_status,
        'src' || cast(o_orderkey % 9 AS STRING) AS source_id, o_orderkey % 11 = 0 AS unavailable, o_orderkey % 13 = 0 AS skipped FROM orders""",
    "runs": """SELECT c_custkey AS run_id, CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' WHEN 2 THEN 'cancelled' ELSE 'completed' END AS status FROM customer""",
    "source_failures": """SELECT event_id AS sequence, 'src' || cast(user_id % 9 AS STRING) AS source_id, ts AS recorded_at, props FROM events WHERE event_type = 'error'""",
    "assertions": """SELECT l_partkey AS release_id, 'src' || cast(l_suppkey % 5 AS STRING) AS source_id,
        CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE p_name || ' ' || cast(l_linenumber AS STRING) END AS value,
        l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3 FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "candidates": f"""SELECT o_orderkey AS candidate_id, p_name AS title,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Nintendo - Nintendo DS' WHEN p_type = 'ECONOMY' THEN 'Nintendo - Game Boy' WHEN p_type = 'LARGE' THEN 'Sony - PlayStation' ELSE 'MAME' END AS platform,
        CASE o_orderkey % 4 WHEN 0 THEN {_REGION} WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Germany' ELSE 'USA' END AS region,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Unspecified' ELSE p_brand END AS edition FROM orders JOIN part ON o_custkey = p_partkey""",
}
TABLES = {"release_editions": ["part"], "assets": ["lineitem"], "work": ["orders"], "runs": ["customer"], "source_failures": ["events"], "assertions": ["lineitem", "part"], "candidates": ["orders", "part"]}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the Parquet tables in `sf_dir`."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    sql = SQL[name]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **tables)


def ctes(*names: str) -> str:
    """The same relations for the head of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
