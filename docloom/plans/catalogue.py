"""The queries of this repository over the standard tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import of_schema
from ..operators.aggregate import aggregated, sort
from ..operators.filters import compiled, nearness
from ..operators.mutate import deleted, updated
from ..operators.project import projected
from ..session import load, ship
from ..sources.bson import read_bson, write_bson
from ..sources.catalog import Database
from ..sources.files import read_csv, read_json, to_json, write_json
from ..streaming.follow import followed
from .commands import Session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def find(name: str, table: str, filter: dict, columns: list[str], where: str, **more) -> None:
    """A filter with an inclusive projection, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, table)
        rows = df.where(compiled(filter, of_schema(df.schema)))
        return projected(rows, dict.fromkeys(columns, 1), filter)

    add(name, run, f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")


def pipeline(name: str, table: str, stages: dict | list, sql: str) -> None:
    add(name, lambda spark, sf_dir: aggregated(load(spark, sf_dir, table), stages), sql)


def project(name: str, table: str, spec: dict, sql: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, filter: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prepare(load(spark, sf_dir, table))
        return projected(df.where(compiled(filter, of_schema(df.schema))), spec, filter)

    add(name, run, sql)


def add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# Grouped aggregation

pipeline(
    "group_sum_count", "lineitem",
    [{"$group": {"_id": "$l_returnflag", "total_qty": {"$sum": "$l_quantity"}, "n": {"$sum": 1}}}],
    "SELECT l_returnflag AS _id, CAST(SUM(l_quantity) AS DOUBLE) AS total_qty, CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1",
)
pipeline(
    "group_sum_int", "part",
    {"$group": {"_id": "$p_brand", "size": {"$sum": "$p_size"}, "twice": {"$sum": 2}}},
    "SELECT p_brand AS _id, CAST(SUM(p_size) AS DOUBLE) AS size, CAST(2 * COUNT(*) AS DOUBLE) AS twice FROM part GROUP BY 1",
)
pipeline(
    "group_sorted", "orders",
    [{"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}, "biggest": {"$max": "$o_totalprice"}}}, {"$sort": {"n": 1, "_id": 1}}],
    "SELECT o_orderpriority AS _id, CAST(COUNT(*) AS DOUBLE) AS n, MAX(o_totalprice) AS biggest FROM orders GROUP BY 1 ORDER BY 2, 1",
)
pipeline(
    "group_min_max_avg", "lineitem",
    {"$group": {"_id": "$l_linestatus", "low": {"$min": "$l_linenumber"}, "high": {"$max": "$l_extendedprice"}, "mean": {"$avg": "$l_linenumber"}, "last": {"$max": "$l_returnflag"}}},
    "SELECT l_linestatus AS _id, CAST(MIN(l_linenumber) AS DOUBLE) AS low, MAX(l_extendedprice) AS high, AVG(l_linenumber) AS mean, MAX(l_returnflag) AS last FROM lineitem GROUP BY 1",
)
pipeline(
    "group_expr", "lineitem",
    {"$group": {"_id": "$l_returnflag", "lines": {"$sum": {"$multiply": ["$l_linenumber", 3]}}, "keys": {"$sum": {"$add": ["$l_partkey", "$l_suppkey", 1]}}}},
    "SELECT l_returnflag AS _id, CAST(SUM(l_linenumber * 3) AS DOUBLE) AS lines, CAST(SUM(l_partkey + l_suppkey + 1) AS DOUBLE) AS keys FROM lineitem GROUP BY 1",
)
add(
    "group_expr_double",
    lambda spark, sf_dir: aggregated(load(spark, sf_dir, "lineitem"), {"$group": {"_id": "$l_returnflag", "revenue": {"$sum": {"$multiply": ["$l_extendedprice", "$l_discount"]}}}}).withColumn("revenue", F.round("revenue", 1)),
    "SELECT l_returnflag AS _id, ROUND(SUM(l_extendedprice * l_discount), 1) AS revenue FROM lineitem GROUP BY 1",
)
pipeline(
    "group_all", "orders",
    [{"$group": {"_id": None, "n": {"$sum": 1}, "low": {"$min": "$o_totalprice"}}}, {"$project": {"_id": 0, "n": 1, "low": 1}}],
    "SELECT CAST(COUNT(*) AS DOUBLE) AS n, MIN(o_totalprice) AS low FROM orders",
)
pipeline(
    "group_multi", "orders",
    [{"$group": {"_id": {"status": "$o_orderstatus", "priority": "$o_orderpriority"}, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1, "status": "$_id.status", "priority": "$_id.priority"}}],
    "SELECT CAST(COUNT(*) AS DOUBLE) AS n, o_orderstatus AS status, o_orderpriority AS priority FROM orders GROUP BY 2, 3",
)
pipeline(
    "match_group_sort_limit", "events",
    [{"$match": {"value": {"$gt": 10}}}, {"$group": {"_id": "$user_id", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 10}],
    "SELECT user_id AS _id, CAST(COUNT(*) AS DOUBLE) AS n FROM events WHERE value > 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
pipeline(
    "sort_skip_limit", "orders",
    [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 20}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}],
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
)
pipeline(
    "unwind_group", "embeddings",
    [{"$unwind": "$embedding"}, {"$match": {"embedding": {"$gt": 0.3}}}, {"$group": {"_id": "$label", "n": {"$sum": 1}}}],
    "SELECT label AS _id, CAST(COUNT(*) AS DOUBLE) AS n FROM (SELECT label, UNNEST(embedding) AS e FROM embeddings) WHERE e > 0.3 GROUP BY 1",
)
pipeline("count", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$count": "n"}], "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'")
add(
    "distinct",
    lambda spark, sf_dir: load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("value")).where("value is not null").distinct(),
    "SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus IS NOT NULL",
)

# Filters

LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
find("find_eq", "orders", {"o_orderstatus": "F"}, ["o_orderkey", "o_orderstatus"], "o_orderstatus = 'F'")
find("find_eq_explicit", "orders", {"o_custkey": {"$eq": 77}}, ["o_orderkey", "o_custkey"], "o_custkey = 77")
find("find_ne", "customer", {"c_mktsegment": {"$ne": "BUILDING"}}, ["c_custkey", "c_mktsegment"], "c_mktsegment <> 'BUILDING'")
find("find_gt_int", "part", {"p_size": {"$gt": 40}}, ["p_partkey", "p_size"], "p_size > 40")
find("find_gt_int_fraction", "part", {"p_size": {"$gt": 39.5}}, ["p_partkey", "p_size"], "p_size > 39.5")
find("find_gt_dbl", "part", {"p_retailprice": {"$gt": 980.0}}, ["p_partkey", "p_retailprice"], "p_retailprice > 980.0")
find("find_gte_int", "lineitem", {"l_linenumber": {"$gte": 3}}, LINE, "l_linenumber >= 3")
find("find_gte_dbl", "lineitem", {"l_quantity": {"$gte": 40.0}}, LINE, "l_quantity >= 40.0")
find("find_lt_int", "lineitem", {"l_linenumber": {"$lt": 3}}, LINE, "l_linenumber < 3")
find("find_lt_dbl", "lineitem", {"l_discount": {"$lt": 0.02}}, LINE, "l_discount < 0.02")
find("find_lte_int", "lineitem", {"l_linenumber": {"$lte": 2}}, LINE, "l_linenumber <= 2")
find("find_lte_dbl", "lineitem", {"l_quantity": {"$lte": 5.0}}, LINE, "l_quantity <= 5.0")
find("find_range", "lineitem", {"l_quantity": {"$gt": 10, "$lt": 20}}, LINE, "l_quantity > 10 AND l_quantity < 20")
find("find_array_any", "embeddings", {"embedding": {"$gt": 0.3}}, ["vec_id"], "len(list_filter(embedding, lambda x: x > 0.3)) > 0")
find("find_array_ne", "embeddings", {"embedding": {"$ne": 0.5}}, ["vec_id"], "len(list_filter(embedding, lambda x: x <> 0.5)) > 0")
find("find_class_mismatch", "orders", {"o_orderstatus": {"$gt": 5}}, ["o_orderkey"], "FALSE")
find("find_missing_field", "orders", {"no_such_field": 1}, ["o_orderkey"], "FALSE")
find("find_and", "lineitem", {"$and": [{"l_quantity": {"$gt": 45}}, {"l_returnflag": "R"}]}, LINE, "l_quantity > 45 AND l_returnflag = 'R'")
find("find_and_implicit", "lineitem", {"l_quantity": {"$gt": 45}, "l_discount": {"$lt": 0.02}}, LINE, "l_quantity > 45 AND l_discount < 0.02")
find("find_or", "lineitem", {"$or": [{"l_quantity": {"$lt": 2}}, {"l_discount": {"$gt": 0.09}}]}, LINE, "l_quantity < 2 OR l_discount > 0.09")
find("find_mixed", "lineitem", {"$or": [{"l_quantity": {"$gt": 10, "$lt": 12}}, {"l_returnflag": "A", "l_linenumber": 1}]}, LINE, "(l_quantity > 10 AND l_quantity < 12) OR (l_returnflag = 'A' AND l_linenumber = 1)")
find("find_mixed_swapped", "lineitem", {"$or": [{"l_returnflag": "A", "l_linenumber": 1}, {"l_quantity": {"$gt": 10, "$lt": 12}}]}, LINE, "(l_quantity > 10 AND l_quantity < 12) OR (l_returnflag = 'A' AND l_linenumber = 1)")
find("find_nor", "orders", {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 200000}}]}, ["o_orderkey"], "NOT COALESCE(o_orderstatus = 'F' OR o_totalprice > 200000, FALSE)")
find("find_not", "orders", {"o_totalprice": {"$not": {"$gt": 100000}}}, ["o_orderkey"], "NOT COALESCE(o_totalprice > 100000, FALSE)")
find("find_in", "nation", {"n_name": {"$in": ["NATION_1", "NATION_5", "NATION_20", 7]}, "n_regionkey": {"$in": [0, 1, 2, 3]}}, ["n_nationkey", "n_name"], "n_name IN ('NATION_1', 'NATION_5', 'NATION_20') AND n_regionkey IN (0, 1, 2, 3)")
find("find_in_int", "orders", {"o_custkey": {"$in": [1, 2, 3.0, 4.5, "x"]}}, ["o_orderkey", "o_custkey"], "o_custkey IN (1, 2, 3)")
find("find_nin", "nation", {"n_regionkey": {"$nin": [0, 2]}}, ["n_nationkey", "n_regionkey"], "NOT COALESCE(n_regionkey IN (0, 2), FALSE)")
find("find_exists", "customer", {"c_acctbal": {"$exists": True}, "nothing": {"$exists": False}}, ["c_custkey"], "c_acctbal IS NOT NULL")
find("find_type", "customer", {"c_name": {"$type": "string"}, "c_acctbal": {"$type": [1, 16]}}, ["c_custkey"], "c_name IS NOT NULL AND c_acctbal IS NOT NULL")
find("find_mod", "part", {"p_partkey": {"$mod": [7, 3]}}, ["p_partkey"], "p_partkey % 7 = 3")
find("find_regex", "customer", {"c_name": {"$regex": "#0+1[0-9]*5$"}}, ["c_custkey", "c_name"], "regexp_matches(c_name, '#0+1[0-9]*5$')")
find("find_regex_options", "part", {"p_type": {"$regex": "eco|small", "$options": "i"}}, ["p_partkey", "p_type"], "regexp_matches(p_type, 'eco|small', 'i')")
find("find_where", "lineitem", {"$where": "l_quantity * l_discount > 4"}, LINE, "l_quantity * l_discount > 4")
find("find_size", "embeddings", {"embedding": {"$size": 64}}, ["vec_id"], "len(embedding) = 64")
find("find_elemmatch", "embeddings", {"embedding": {"$elemMatch": {"$gt": 0.25, "$lt": 0.3}}}, ["vec_id"], "len(list_filter(embedding, lambda x: x > 0.25 AND x < 0.3)) > 0")
find("find_time", "orders", {"o_orderdate": {"$gte": dt.datetime(1996, 1, 1), "$lt": dt.datetime(1997, 1, 1)}}, ["o_orderkey", "o_orderdate"], "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")


def _split_names(df: DataFrame) -> DataFrame:
    """Words of the parts' names, as an array."""
    return df.select("p_partkey", F.split("p_name", " ").alias("words"), F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("of")).alias("about"))


def _on_parts(name: str, filter: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _split_names(load(spark, sf_dir, "part"))
        return df.where(compiled(filter, of_schema(df.schema))).select("p_partkey")

    add(name, run, f"SELECT p_partkey FROM part WHERE {sql}")


_on_parts("find_nested_path", {"about.size": {"$gt": 40}, "about.of.brand": {"$ne": "Brand#11"}}, "p_size > 40 AND p_brand <> 'Brand#11'")
_on_parts("find_subdocument", {"about": {"size": 10}}, "p_size = 10")
_on_parts("find_all_words", {"words": {"$all": ["small", "ring"]}}, "list_contains(string_split(p_name, ' '), 'small') AND list_contains(string_split(p_name, ' '), 'ring')")
_on_parts("find_array_regex", {"words": {"$regex": "^r.*g$"}}, "len(list_filter(string_split(p_name, ' '), lambda x: regexp_matches(x, '^r.*g$'))) > 0")
_on_parts("find_array_in", {"words": {"$in": ["red", "blue", "none"]}}, "list_has_any(string_split(p_name, ' '), ['red', 'blue', 'none'])")
_on_parts("find_array_position", {"words.0": {"$gte": "m"}}, "string_split(p_name, ' ')[1] >= 'm'")


def _json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    return df.where(compiled({"k": {"$gt": 50}}, of_schema(df.schema, "doc"))).select("event_id", F.try_variant_get("doc", "$.k", "bigint").alias("k"))


add("json_path", _json_path, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")


# Places: customers at (account balance, nation).

PLACE = "c_acctbal, CAST(c_nationkey AS DOUBLE)"


def _places(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("loc"))


def _geo(name: str, filter: dict, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _places(load(spark, sf_dir, "customer"))
        return df.where(compiled(filter, of_schema(df.schema))).select("c_custkey")

    add(name, run, f"SELECT c_custkey FROM (SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer) WHERE {where}")


_geo("find_geo_box", {"loc": {"$geoWithin": {"$box": [[0, 5], [1000, 15]]}}}, "x BETWEEN 0 AND 1000 AND y BETWEEN 5 AND 15")
_geo("find_geo_center", {"loc": {"$geoWithin": {"$center": [[500, 10], 250.5]}}}, "sqrt(pow(x - 500, 2) + pow(y - 10, 2)) <= 250.5")
_geo("find_geo_polygon", {"loc": {"$geoWithin": {"$polygon": [[0, 0], [2000, 0], [2000, 20.5]]}}}, "y > 0 AND x < 2000 AND y < x * 20.5 / 2000 OR (y = 0 AND x >= 0 AND x < 2000)")
_geo("find_geo_intersects", {"loc": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [[[100.5, 2.5], [900.5, 2.5], [900.5, 9.5], [100.5, 9.5], [100.5, 2.5]]]}}}}, "x > 100.5 AND x < 900.5 AND y > 2.5 AND y < 9.5")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    filter = {"loc": {"$near": [500, 10], "$maxDistance": 100}}
    df = _places(load(spark, sf_dir, "customer"))
    scope = of_schema(df.schema)
    return df.where(compiled(filter, scope)).orderBy(nearness(filter, scope), "c_custkey").limit(5).select("c_custkey")


add("find_near", _near, "SELECT c_custkey FROM customer WHERE sqrt(pow(c_acctbal - 500, 2) + pow(c_nationkey - 10, 2)) <= 100 ORDER BY sqrt(pow(c_acctbal - 500, 2) + pow(c_nationkey - 10, 2)), c_custkey LIMIT 5")


def _near_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer").select("c_custkey", F.struct((F.col("c_nationkey") * 5.0).alias("lon"), (F.col("c_acctbal") / 200).alias("lat")).alias("loc"))
    filter = {"loc": {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [50, 10]}, "$maxDistance": 2_000_000}}}
    return df.where(compiled(filter, of_schema(df.schema))).select("c_custkey")


HAVERSINE = "2 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 50) / 2), 2))))"
add("find_near_sphere", _near_sphere, f"SELECT c_custkey FROM (SELECT c_custkey, c_nationkey * 5.0::DOUBLE AS lon, c_acctbal / 200 AS lat FROM customer) WHERE {HAVERSINE} * 6378100 <= 2000000")

# Projections


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("c_custkey", "_id")


project("project_all", "region", {}, "SELECT * FROM region")
project("project_include", "customer", {"c_name": 1, "c_acctbal": True, "nothing": 1}, "SELECT c_name, c_acctbal FROM customer")
project("project_exclude", "customer", {"c_name": 0, "c_acctbal": 0}, "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
project("project_id_default", "customer", {"c_name": 1}, "SELECT c_custkey AS _id, c_name FROM customer", _with_id)
project("project_id_dropped", "customer", {"_id": 0}, "SELECT * EXCLUDE (c_custkey) FROM customer", _with_id)
project("project_id_and_fields", "customer", {"_id": 0, "c_name": 1}, "SELECT c_name FROM customer", _with_id)
project("project_computed", "lineitem", {"l_orderkey": 1, "l_linenumber": 1, "net": {"$add": ["$l_extendedprice", "$l_quantity"]}, "tripled": {"$multiply": ["$l_linenumber", 3]}}, "SELECT l_orderkey, l_linenumber, l_extendedprice + l_quantity AS net, CAST(l_linenumber AS BIGINT) * 3 AS tripled FROM lineitem")
project("project_slice", "embeddings", {"vec_id": 1, "embedding": {"$slice": 3}}, "SELECT vec_id, embedding[1:3] AS embedding FROM embeddings")
project("project_slice_tail", "embeddings", {"vec_id": 1, "embedding": {"$slice": [60, 2]}}, "SELECT vec_id, embedding[61:62] AS embedding FROM embeddings")
project(
    "project_positional", "embeddings", {"vec_id": 1, "embedding.$": 1},
    "SELECT vec_id, list_filter(embedding, lambda x: x > 0.3)[1:1] AS embedding FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0",
    filter={"embedding": {"$gt": 0.3}},
)
add(
    "project_nested",
    lambda spark, sf_dir: projected(_split_names(load(spark, sf_dir, "part")), {"p_partkey": 1, "about.of.brand": 1}).select("p_partkey", F.col("about.of.brand").alias("brand")),
    "SELECT p_partkey, p_brand AS brand FROM part",
)
add(
    "project_nested_exclude",
    lambda spark, sf_dir: projected(_split_names(load(spark, sf_dir, "part")), {"about.of": 0, "words": 0}).select("p_partkey", "about.*"),
    "SELECT p_partkey, p_size AS size FROM part",
)

# Sources, sinks and changes


def _own(spark: SparkSession) -> Database:
    """A database of this application: a catalog in memory forgets tables whose files stay."""
    return Database(spark, "docloom_" + re.sub(r"\W", "_", spark.sparkContext.applicationId))


def _insert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection made by two inserts, found again."""
    coll = _own(spark)["regions"]
    coll.drop()
    coll.insert_frame(load(spark, sf_dir, "region"))
    coll.insert_many([{"r_regionkey": 100, "r_name": "NOWHERE", "note": "new"}, {"r_regionkey": 101, "note": None}])
    return coll.find({}).select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name", "note")


add("insert_roundtrip", _insert_roundtrip, "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region UNION ALL VALUES (100, 'NOWHERE', 'new'), (101, NULL, NULL)")


def _save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection saved and loaded under another name."""
    db = _own(spark)
    at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{db.name}_saved/nation"
    db.register("nation_view", load(spark, sf_dir, "nation")).save(at, mode="overwrite")
    return db.load("nation_copy", at).find()


add("save_load", _save_load, "SELECT * FROM nation")
add(
    "json_roundtrip",
    lambda spark, sf_dir: _json_back(load(spark, sf_dir, "supplier")),
    "SELECT * FROM supplier",
)


def _json_back(df: DataFrame) -> DataFrame:
    """Documents as JSON and back."""
    return to_json(df).select(F.from_json("value", df.schema).alias("d")).select("d.*")


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted(load(spark, sf_dir, "orders"), {"o_orderstatus": {"$in": ["F", "O"]}}).select("o_orderkey", "o_orderstatus")


def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "supplier")
    return updated(df, {"s_acctbal": {"$lt": 0}}, {"$set": {"s_name": "in debt", "flag": 1}, "$inc": {"s_nationkey": 100}})


add("delete_many", _delete, "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT COALESCE(o_orderstatus IN ('F', 'O'), FALSE)")
add(
    "update_many",
    _update,
    "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'in debt' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey, s_acctbal, CASE WHEN s_acctbal < 0 THEN CAST(1 AS BIGINT) END AS flag FROM supplier",
)
add(
    "compare_collections",
    lambda spark, sf_dir: load(spark, sf_dir, "nation").exceptAll(load(spark, sf_dir, "nation").where("n_nationkey > 3")),
    "SELECT * FROM nation WHERE n_nationkey <= 3",
)
add(
    "find_sorted",
    lambda spark, sf_dir: sort(load(spark, sf_dir, "customer").where(compiled({"c_acctbal": {"$gt": 9000}}, of_schema(load(spark, sf_dir, "customer").schema))), {"c_acctbal": -1, "c_custkey": 1}).limit(25).select("c_custkey", "c_acctbal"),
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 ORDER BY 2 DESC, 1 LIMIT 25",
)


def _copied(spark: SparkSession, sf_dir: str, table: str):
    """A collection of its own with the rows of a table."""
    coll = _own(spark)[f"{table}_copy"]
    coll.drop()
    coll.insert_frame(load(spark, sf_dir, table))
    return coll


def _delete_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted from a stored collection, with how many went."""
    coll = _copied(spark, sf_dir, "orders")
    n = coll.delete_many({"$or": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 300000}}]})
    return coll.find().select("o_orderkey", "o_orderstatus", F.lit(n).cast("bigint").alias("n_deleted"))


GONE = "o_orderstatus = 'F' OR o_totalprice > 300000"
add("delete_rewrite", _delete_rewrite, f"SELECT o_orderkey, o_orderstatus, (SELECT COUNT(*) FROM orders WHERE {GONE}) AS n_deleted FROM orders WHERE NOT ({GONE})")


def _update_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed in a stored collection, with how many were."""
    coll = _copied(spark, sf_dir, "supplier")
    n = coll.update_many({"s_acctbal": {"$not": {"$gte": 0}}}, {"$set": {"s_name": "in debt"}, "$inc": {"s_nationkey": 1}})
    return coll.find().withColumn("n_changed", F.lit(n).cast("bigint"))


add(
    "update_rewrite",
    _update_rewrite,
    "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'in debt' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey, s_acctbal, (SELECT COUNT(*) FROM supplier WHERE s_acctbal < 0) AS n_changed FROM supplier",
)


def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "nation")
    db = _own(spark)
    return db.register("nation_a", df).difference(db.register("nation_b", df.where("n_nationkey > 3").union(df.where("n_nationkey = 10"))))


add("compare_difference", _difference, "SELECT *, CAST(n_nationkey <= 3 AS BIGINT) AS only_here, CAST(n_nationkey = 10 AS BIGINT) AS only_there FROM nation WHERE n_nationkey <= 3 OR n_nationkey = 10")


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comparing a collection with itself, with a part of itself and with other fields says."""
    df = load(spark, sf_dir, "nation")
    coll = _own(spark).register("nation_a", df.repartition(3))
    told = [("itself", *coll.compare(df)), ("a part", *coll.compare(df.where("n_nationkey > 3"))), ("other fields", *coll.compare(df.drop("n_name")))]
    return spark.createDataFrame(told, "other string, same boolean, note string")


add("compare_report", _compare, "SELECT * FROM (VALUES ('itself', TRUE, ''), ('a part', FALSE, '4 documents only here, 0 only there'), ('other fields', FALSE, 'fields differ: [''n_name'']')) AS t(other, same, note)")


def _at(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{_own(spark).name}_saved/{name}_{uuid.uuid4().hex}"


def _json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back."""
    df, at = load(spark, sf_dir, "supplier"), _at(spark, "json")
    write_json(df, at)
    return read_json(spark, at, df.schema)


def _csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, at = load(spark, sf_dir, "supplier"), _at(spark, "csv")
    df.write.option("header", True).csv(at)
    return read_csv(spark, at, df.schema)


def _bson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with nested fields and times, as binary documents and back."""
    df, at = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("at"), F.struct("o_orderstatus", F.array("o_custkey", "o_orderkey").alias("keys")).alias("about")), _at(spark, "bson")
    ship(spark)
    write_bson(df, at)
    back = read_bson(spark, at, df.schema)
    return back.select("o_orderkey", "o_totalprice", F.col("at").cast("timestamp_ntz").alias("o_orderdate"), "about.o_orderstatus", F.col("about.keys")[0].alias("o_custkey"))


add("json_files", _json_files, "SELECT * FROM supplier")
add("csv_import", _csv_import, "SELECT * FROM supplier")
add("bson_files", _bson_files, "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus, o_custkey FROM orders")


def _cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, page by page."""
    cursor = _own(spark).register("nation_view", load(spark, sf_dir, "nation")).find_cursor({"n_regionkey": {"$gt": 0}}, ["n_nationkey", "n_name"], {"n_nationkey": -1}, batch_size=7)
    rows = []
    while page := cursor.next_batch():
        rows += [(d["n_nationkey"], d["n_name"], len(page)) for d in page]
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, page_rows bigint")


add("cursor_pages", _cursor_pages, "SELECT n_nationkey, n_name, LEAST(7, n - 7 * ((k - 1) // 7)) AS page_rows FROM (SELECT n_nationkey, n_name, ROW_NUMBER() OVER (ORDER BY n_nationkey DESC) AS k, COUNT(*) OVER () AS n FROM nation WHERE n_regionkey > 0)")


def _admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(_own(spark))
    names = ("ping", "isMaster", "buildInfo", "getLog", "replSetGetStatus", "getLastError", "whatsmyuri")
    return spark.createDataFrame([(n, session.run({n: 1})["ok"]) for n in names], "command string, ok double")


add("commands_admin", _admin, "SELECT * FROM (VALUES ('ping', 1.0::DOUBLE), ('isMaster', 1.0), ('buildInfo', 1.0), ('getLog', 1.0), ('replSetGetStatus', 0.0), ('getLastError', 1.0), ('whatsmyuri', 1.0)) AS t(command, ok)")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as documents, over a collection made of the regions."""
    db = _own(spark)
    db["by_command"].drop()
    session, out = Session(db), []
    docs = [r.asDict() for r in load(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    out.append(("insert", session.run({"insert": "by_command", "documents": docs})["n"]))
    first = session.run({"find": "by_command", "filter": {"r_regionkey": {"$gte": 1}}, "batchSize": 2})["cursor"]
    more = session.run({"getMore": first["id"], "batchSize": 9})["cursor"]
    out += [("find", len(first["firstBatch"])), ("getMore", len(more["nextBatch"])), ("open cursors", len(session.cursors))]
    held = session.run({"aggregate": "by_command", "pipeline": [{"$match": {}}], "cursor": {"batchSize": 1}})["cursor"]["id"]
    out.append(("killCursors", len(session.run({"killCursors": "by_command", "cursors": [held]})["cursorsKilled"])))
    out.append(("distinct", len(session.run({"distinct": "by_command", "key": "r_name"})["values"])))
    out.append(("update", session.run({"update": "by_command", "updates": [{"q": {"r_regionkey": {"$lt": 2}}, "u": {"$set": {"r_name": "changed"}}}]})["n"]))
    out.append(("count", session.run({"count": "by_command", "query": {"r_name": "changed"}})["n"]))
    out.append(("delete", session.run({"delete": "by_command", "deletes": [{"q": {"r_name": "changed"}}, {"q": {"r_regionkey": 4}}]})["n"]))
    stats = session.run({"explain": {"find": "by_command", "filter": {"r_regionkey": {"$gt": 2}}}})["executionStats"]
    out += [("explain: documents", stats["nReturned"]), ("explain: bytes", int(stats["bytesExamined"] > 0))]
    out.append(("namespace", db.of_namespace(f"{db.name}.by.command").find().count()))
    return spark.createDataFrame(out, "step string, n bigint")


add(
    "commands_data",
    _commands,
    "SELECT * FROM (VALUES ('insert', 5), ('find', 2), ('getMore', 2), ('open cursors', 0), ('killCursors', 1), ('distinct', 5), ('update', 2), ('count', 2), ('delete', 3), ('explain: documents', 1), ('explain: bytes', 1), ('namespace', 2)) AS t(step, n)",
)


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over documents that arrive as files, run over those that are there."""
    at = _at(spark, "stream")
    df = load(spark, sf_dir, "events")
    rows = followed(spark, f"{sf_dir}/events.parquet*", df.schema, {"value": {"$gt": 50}, "event_type": {"$ne": "click"}}, ["event_id", "value"], "parquet")
    rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


add("follow_filter", _followed, "SELECT event_id, value FROM events WHERE value > 50 AND event_type <> 'click'")

# Values at the ends of their types, and negations


def _on(name: str, table: str, prepare: Callable[[DataFrame], DataFrame], filter: dict, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prepare(load(spark, sf_dir, table))
        return df.where(compiled(filter, of_schema(df.schema))).select(*columns)

    add(name, run, sql)


def _odd_numbers(df: DataFrame) -> DataFrame:
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(1e300)).when(F.col("l_linenumber") == 3, F.lit(float("-inf"))).otherwise(F.col("l_quantity"))
    return df.withColumn("x", odd)


_on("find_mod_double", "lineitem", _odd_numbers, {"x": {"$mod": [7, 3]}}, LINE, f"SELECT {', '.join(LINE)} FROM lineitem WHERE l_linenumber > 3 AND CAST(trunc(l_quantity) AS BIGINT) % 7 = 3")
find("find_regular_expression", "customer", {"c_name": {"$regularExpression": {"pattern": "#0+1[0-9]*5$", "options": "i"}}}, ["c_custkey", "c_name"], "regexp_matches(c_name, '#0+1[0-9]*5$')")
find("find_in_regular_expression", "part", {"p_type": {"$in": ["none", {"$regularExpression": {"pattern": "^ECO", "options": "i"}}]}}, ["p_partkey", "p_type"], "regexp_matches(p_type, '^ECO', 'i')")


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumn("q", F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))).withColumn("f", F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")))


Q, R = "(CASE WHEN l_linenumber <> 2 THEN l_quantity END)", "(CASE WHEN l_linenumber <> 3 THEN l_returnflag END)"
_on("find_nor_nested", "lineitem", _with_nulls, {"$nor": [{"$and": [{"q": {"$gt": 10}}, {"f": {"$nin": ["A"]}}]}, {"q": {"$not": {"$lt": 45}}}]}, LINE, f"SELECT {', '.join(LINE)} FROM lineitem WHERE NOT (COALESCE({Q} > 10, FALSE) AND NOT COALESCE({R} = 'A', FALSE)) AND COALESCE({Q} < 45, FALSE)")
_on("find_nin_nulls", "lineitem", _with_nulls, {"f": {"$nin": ["A", "R"]}, "q": {"$not": {"$gte": 20, "$lt": 40}}}, LINE, f"SELECT {', '.join(LINE)} FROM lineitem WHERE NOT COALESCE({R} IN ('A', 'R'), FALSE) AND NOT COALESCE({Q} >= 20 AND {Q} < 40, FALSE)")
add(
    "group_sum_overflow",
    lambda spark, sf_dir: aggregated(load(spark, sf_dir, "nation").select("n_regionkey", F.lit(9 * 10**18).alias("big")), {"$group": {"_id": "$n_regionkey", "total": {"$sum": "$big"}}}),
    "SELECT n_regionkey AS _id, SUM(9000000000000000000::DOUBLE) AS total FROM nation GROUP BY 1",
)
add(
    "skip_rows",
    lambda spark, sf_dir: aggregated(aggregated(load(spark, sf_dir, "lineitem"), [{"$match": {"l_quantity": {"$gt": 20}}}, {"$skip": 1234}]), {"$count": "n"}),
    "SELECT GREATEST(COUNT(*) - 1234, 0) AS n FROM lineitem WHERE l_quantity > 20",
)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``$elemMatch`` in documents of any shape."""
    df = load(spark, sf_dir, "part").select("p_partkey", F.parse_json(F.to_json(F.struct(F.array(F.struct("p_size", "p_brand"), F.struct(F.lit(0).alias("p_size"), F.lit("none").alias("p_brand"))).alias("items")))).alias("doc"))
    return df.where(compiled({"items": {"$elemMatch": {"p_size": {"$gt": 40}, "p_brand": {"$regex": "1$"}}}}, of_schema(df.schema, "doc"))).select("p_partkey")


add("find_elemmatch_dynamic", _elements, "SELECT p_partkey FROM part WHERE p_size > 40 AND regexp_matches(p_brand, '1$')")
