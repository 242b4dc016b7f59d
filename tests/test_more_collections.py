"""Negations at the scan, values at the ends of types, replaced tables, BSON, metrics."""

import datetime as dt
import math
import struct

import pytest
from pyspark.sql import functions as F

from docloom.functions.paths import of_schema
from docloom.functions.types import RequestError
from docloom.operators.aggregate import aggregated
from docloom.operators.filters import compiled
from docloom.operators.mutate import deleted
from docloom.plans.commands import Session
from docloom.plans.metrics import measured
from docloom.sources import bson, files
from docloom.sources.catalog import Database

LINES = "/root/testdata/sf0.001/lineitem.parquet"


@pytest.fixture
def db(spark):
    out = Database(spark, "more_tests")
    yield out
    out.drop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("filter", "pushed"),
    [
        ({"l_linenumber": {"$nin": [1, 2]}}, ["Or(IsNull(l_linenumber),Not(In(l_linenumber,[1,2])))"]),
        ({"l_quantity": {"$not": {"$gt": 10}}}, ["Or(IsNull(l_quantity),LessThanOrEqual(l_quantity,10.0))"]),
        ({"$nor": [{"l_quantity": {"$gt": 10}}, {"l_returnflag": "A"}]}, ["Or(IsNull(l_quantity),LessThanOrEqual(l_quantity,10.0))", "Or(IsNull(l_returnflag),Not(EqualTo("]),
        ({"$nor": [{"$nor": [{"l_quantity": {"$lt": 10}}]}]}, ["LessThan(l_quantity,10.0)"]),
    ],
)
def test_negations_reach_the_scan(spark, filter, pushed):
    df = spark.read.parquet(LINES)
    plan = plan_of(df.where(compiled(filter, of_schema(df.schema))))
    scan = plan.split("PushedFilters")[1].replace(", ", ",")
    assert all(x in scan for x in pushed), scan


def test_negate_is_the_complement(spark):
    """Each row satisfies a filter or its negation, never both."""
    rows = [(i, None if i % 5 == 0 else i % 7, [None, "a", "b"][i % 3], [i % 4, i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, n int, s string, xs array<int>")
    filters = [
        {"n": 3}, {"n": {"$ne": 3}}, {"n": {"$gt": 2, "$lt": 5}}, {"n": {"$in": [1, None]}}, {"n": {"$nin": [1]}}, {"n": {"$not": {"$gte": 4}}}, {"n": {"$exists": False}}, {"s": {"$regex": "a"}}, {"xs": {"$gt": 2}}, {"xs": {"$size": 2}},
        {"$or": [{"n": 1}, {"s": "b"}]}, {"$and": [{"n": {"$lt": 4}}, {"$nor": [{"s": "a"}, {"xs": 0}]}]}, {"gone": 1}, {"gone": {"$not": {"$gt": 1}}}, {"$where": "n > 2"}, {}, {"xs": {"$elemMatch": {"$gt": 1, "$lt": 3}}}, {"n": {"$mod": [2, 1]}},
    ]
    for f in filters:
        yes = {r["id"] for r in df.where(compiled(f, of_schema(df.schema))).collect()}
        no = {r["id"] for r in deleted(df, f).collect()}
        twice = {r["id"] for r in df.where(compiled({"$nor": [{"$nor": [f]}]} if f else {}, of_schema(df.schema))).collect()}
        assert yes | no == set(range(60)) and not yes & no and twice == yes, f


def test_ends_of_types(spark):
    df = spark.createDataFrame([(1, 2**62, math.nan), (1, 2**62, math.inf), (1, 2**62, 7.5), (2, None, -1e300), (2, None, None)], "k int, big long, x double")
    assert [r["x"] for r in df.where(compiled({"x": {"$mod": [7, 0]}}, of_schema(df.schema))).collect()] == [7.5]
    out = aggregated(df, {"$group": {"_id": "$k", "s": {"$sum": "$big"}, "n": {"$sum": 1}}}).collect()
    assert {r["_id"]: (r["s"], r["n"]) for r in out} == {1: (3.0 * 2**62, 3.0), 2: (None, 2.0)}


def test_skip_stays_in_tasks(spark):
    df = spark.read.parquet(LINES)
    total = df.count()
    rest = aggregated(df, [{"$skip": 100}])
    assert rest.count() == total - 100 and rest.columns == df.columns and aggregated(df, [{"$skip": total + 5}]).count() == 0
    plan = plan_of(rest)
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0] and "GlobalLimit" not in plan
    assert aggregated(df.orderBy("l_orderkey"), [{"$sort": {"l_orderkey": 1}}, {"$skip": 3}, {"$limit": 2}]).count() == 2
    with pytest.raises(RequestError):
        aggregated(df, [{"$skip": -1}])


def test_broken_replacement(spark, db):
    """A replacement that breaks off at any point leaves the old documents or the new ones."""
    coll = db["things"]
    coll.insert_many([{"a": k} for k in range(10)])
    # Between the two renames: the old table is aside, the new one whole.
    spark.sql("CREATE TABLE more_tests.things__next USING parquet AS SELECT a FROM more_tests.things WHERE a < 3")
    spark.sql("ALTER TABLE more_tests.things RENAME TO more_tests.things__old")
    assert db.collection_names() == ["things"] and db["things"].count() == 3 and db.collection_names() == ["things"]
    # The new table has gone, or was never made.
    spark.sql("ALTER TABLE more_tests.things RENAME TO more_tests.things__old")
    assert db["things"].count() == 3
    # A table beside that wasn't finished is written anew.
    spark.sql("CREATE TABLE more_tests.things__next USING parquet AS SELECT 7 AS b")
    assert db["things"].delete_many({"a": 0}) == 1 and db["things"].update_many({"a": {"$gt": 50}}, {"$inc": {"a": 1}}) == 0
    assert sorted(r["a"] for r in db["things"].find().collect()) == [1, 2] and db.collection_names() == ["things"]


def test_bson_published_examples():
    hello = b"\x16\0\0\0\x02hello\0\x06\0\0\0world\0\0"
    assert bson.decode(hello) == {"hello": "world"} and bson.encode({"hello": "world"}) == hello
    awesome = b"\x31\0\0\0\x04BSON\0\x26\0\0\0\x02\x30\0\x08\0\0\0awesome\0\x01\x31\0\x33\x33\x33\x33\x33\x33\x14\x40\x10\x32\0\xc2\x07\0\0\0\0"
    assert bson.decode(awesome) == {"BSON": ["awesome", 5.05, 1986]}


def test_bson_types():
    def doc(*elements):
        body = b"".join(bytes([kind]) + name + b"\0" + data for kind, name, data in elements)
        return struct.pack("<i", len(body) + 5) + body + b"\0"

    raw = doc(
        (0x07, b"_id", bytes(range(12))), (0x09, b"at", struct.pack("<q", 1_000)), (0x0B, b"re", b"^a\0i\0"), (0x11, b"ts", struct.pack("<II", 5, 9)), (0x12, b"l", struct.pack("<q", -(2**60))),
        (0x05, b"bin", struct.pack("<iB", 3, 0) + b"abc"), (0x05, b"old", struct.pack("<iBi", 7, 2, 3) + b"abc"), (0xFF, b"min", b""), (0x7F, b"max", b""), (0x06, b"u", b""), (0x0A, b"n", b""), (0x08, b"t", b"\1"),
        (0x13, b"dec", struct.pack("<QQ", 12345, (6176 - 2) << 49)), (0x13, b"nan", struct.pack("<QQ", 0, 0x7C << 56)), (0x0D, b"js", b"\3\0\0\0f;\0"), (0x0F, b"scoped", struct.pack("<i", 4 + 4 + 3 + 5) + b"\3\0\0\0f;\0" + b"\5\0\0\0\0"),
    )
    got = bson.decode(raw)
    assert math.isnan(got.pop("nan"))
    assert got == {"_id": bytes(range(12)).hex(), "at": "1970-01-01T00:00:01.000+00:00", "re": {"pattern": "^a", "options": "i"}, "ts": 9 << 32 | 5, "l": -(2**60), "bin": "YWJj", "old": "YWJj", "min": "$minKey", "max": "$maxKey", "u": None, "n": None, "t": True, "dec": 123.45, "js": "f;", "scoped": "f;"}
    for broken in (raw[:-1], raw[:20], b"\5\0\0\0\1", doc((0x55, b"x", b""))):
        with pytest.raises((ValueError, struct.error)):
            bson.decode(broken)


def test_bson_files(spark, tmp_path):
    rows = [(k, f"é{k}", [k, None], dt.datetime(2020, 1, 1, 12, 0, k), bytes([k]), (k / 2, None)) for k in range(40)]
    schema = "_id long, s string, xs array<long>, at timestamp, raw binary, sub struct<x:double,y:string>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    path = str(tmp_path / "dump")
    bson.write_bson(df, path)
    bson.write_bson(df.limit(0), path)
    assert not [p for p in (tmp_path / "dump").iterdir() if p.name.startswith("_")]
    back = bson.read_bson(spark, path, schema)
    assert sorted(back.collect()) == sorted(df.collect())
    dynamic = bson.read_bson(spark, path)
    assert dynamic.where(compiled({"sub.x": {"$gte": 19}, "s": {"$regex": "^é"}}, of_schema(dynamic.schema, "doc"))).count() == 2


def test_extended_json_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": {"$timestamp": {"t": 2, "i": 3}}, "b": {"$numberDecimal": "1.5"}, "c": {"$minKey": 1}, "d": {"$regularExpression": {"pattern": "^x", "options": "i"}}, "e": {"$undefined": true}}\n{"a": null}\n')
    out = [r.asDict(recursive=True) for r in files.read_json(spark, str(tmp_path)).collect()]
    assert out[0] == {"a": 2 << 32 | 3, "b": 1.5, "c": "$minKey", "d": {"pattern": "^x", "options": "i"}, "e": None}
    assert out[1]["a"] is None and out[1]["c"] is None


def test_metrics(spark, db):
    df = spark.read.parquet(LINES)
    got = measured(aggregated(df.where("l_quantity > 20"), [{"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}}}]))
    assert got.documents == 3 and got.files == 1 and got.bytes > 10_000 and got.examined == df.count() and got.seconds > 0
    db.register("lines", df)
    reply = Session(db).run({"explain": {"find": "lines", "filter": {"l_quantity": {"$gt": 20}}}})
    assert reply["executionStats"]["nReturned"] == df.where("l_quantity > 20").count() and reply["ok"] == 1.0
    for wrong in ({"explain": {"count": "lines"}}, {"mapReduce": "lines", "map": "f", "reduce": "g"}):
        with pytest.raises(RequestError):
            Session(db).run(wrong)


def test_difference(spark, db):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k int, s string")
    coll = db.register("a", a)
    out = {(r["k"], r["s"]): (r["only_here"], r["only_there"]) for r in coll.difference(a.where("k < 3").union(a.where("k = 2")).select("k", "s")).collect()}
    assert out == {(3, "y"): (1, 0), (2, None): (0, 1)}
    assert coll.compare(a.select("s", "k")) == (True, "") and coll.compare(a.limit(0)) == (False, "4 documents only here, 0 only there")
