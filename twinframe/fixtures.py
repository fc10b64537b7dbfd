"""Bindings of the panel's inputs onto the star-schema tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DAILY = """SELECT concat('0', CAST(l_suppkey % 5 AS STRING)) AS geoid, CAST(l_shipdate AS DATE) AS valid_date,
 20 + avg(l_quantity)/2 AS tmmx, 5 + avg(l_quantity)/4 AS tmmn, 10 + avg(l_discount)*800 AS rmin, 30 + avg(l_tax)*800 AS rmax
 FROM lineitem GROUP BY 1, 2"""
REPORTS = """SELECT 'county' AS geo_level, concat('0', CAST(l_suppkey % 5 AS STRING)) AS geoid, CAST(l_shipdate AS DATE) AS valid_date,
 CASE WHEN l_returnflag = 'R' THEN 'rmin' ELSE 'tmmx' END AS variable, CAST('gridmet' AS STRING) AS source, CAST(l_quantity AS DOUBLE) AS value,
 CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' DAY * l_linenumber AS known_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"""
OUTAGE = """SELECT concat('04', lpad(CAST(user_id % 20 AS STRING), 3, '0')) AS geoid,
 CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL '15' MINUTE * CAST(floor(extract(MINUTE FROM ts)/15) AS INT) AS ts_utc,
 max(value) AS customers_out, CAST(max(100 + (user_id % 20) * 10) AS DOUBLE) AS customers FROM events GROUP BY 1, 2"""
CHILD = """SELECT CAST(c_nationkey AS STRING) AS geoid, CAST(o_orderdate AS DATE) AS valid_date, 'spend' AS variable, avg(o_totalprice) AS value
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
WEIGHTS = """SELECT CAST(n_nationkey AS STRING) AS geoid, CAST(n_regionkey AS STRING) AS parent, CAST(count(*) AS DOUBLE) AS population
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
COUNTIES = """SELECT concat('0', CAST(s_suppkey % 5 AS STRING)) AS geoid, CASE WHEN s_suppkey % 5 < 2 THEN 'a' ELSE 'b' END AS parent, CAST(count(*) + s_suppkey % 5 AS DOUBLE) AS population
 FROM supplier GROUP BY s_suppkey % 5"""
PRED = """SELECT o_orderkey AS prediction_id, 'state' AS geo_level, CAST(c_nationkey AS STRING) AS geoid, CAST(o_orderdate AS DATE) AS target_date, 'load' AS quantity,
 o_totalprice/1000 AS value, o_totalprice/1250 AS value_lower, o_totalprice/800 AS value_upper, 'm1' AS model_name, o_orderstatus AS model_version,
 CAST(o_orderdate AS TIMESTAMP) - INTERVAL '1' DAY * CAST(o_orderkey % 5 AS INT) AS issued_at,
 CASE WHEN o_orderkey % 7 = 0 THEN 'warm' END AS scenario_id FROM orders JOIN customer ON o_custkey = c_custkey"""
OBS_ROWS = """SELECT 'state' AS geo_level, CAST(s_nationkey AS STRING) AS geoid, CAST(l_shipdate AS DATE) AS target_date, 'load' AS quantity,
 CAST(l_extendedprice AS DOUBLE)/1000 AS value, l_quantity < 10 AS censored, CAST(0 AS DOUBLE) AS censor_lo, CAST(250 AS DOUBLE) AS censor_hi,
 CAST(l_shipdate AS TIMESTAMP) AS known_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
OBS = """SELECT 'state' AS geo_level, CAST(s_nationkey AS STRING) AS geoid, CAST(l_shipdate AS DATE) AS target_date, 'load' AS quantity,
 sum(l_extendedprice)/1000 AS value, count(*) < 2 AS censored, CAST(0 AS DOUBLE) AS censor_lo, CAST(250 AS DOUBLE) AS censor_hi,
 CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) - INTERVAL '3' DAY + INTERVAL '1' DAY * CAST(count(*) AS INT) AS known_at, 0 AS revision
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE)"""
SCORED = """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS score_a, CAST(o_custkey AS DOUBLE) AS score_b,
 CAST(c_nationkey AS STRING) AS grp, CAST(o_orderdate AS DATE) AS valid_date FROM orders JOIN customer ON o_custkey = c_custkey"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding over the Parquet tables of a folder."""
    named = re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` AS {m[2]}", sql)
    return spark.sql(named)
