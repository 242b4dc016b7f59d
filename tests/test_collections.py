"""Collections, filters on hand-made documents, cursors and commands."""

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.paths import of_schema
from docloom.functions.types import RequestError, decoded
from docloom.operators.aggregate import aggregated
from docloom.operators.filters import compiled
from docloom.operators.project import projected
from docloom.plans.commands import Session
from docloom.sources.catalog import Database
from docloom.sources.cursor import Cursor
from docloom.sources.files import read_csv, read_dynamic, read_json, to_json

PLACES = [
    {"_id": "1", "city": "Ashby", "loc": [-86.5, 33.1], "pop": 6055, "state": "AL"},
    {"_id": "2", "city": "Birk", "loc": [-86.9, 33.6], "pop": 10616, "state": "AL"},
    {"_id": "3", "city": "Colm", "loc": [-87.1, 34.2], "pop": 3205, "state": "GA"},
    {"_id": "4", "city": "Dorn", "loc": [-85.9, 34.1], "pop": 14218, "state": "GA"},
    {"_id": "5", "city": "Ente", "loc": [-86.0, 32.9], "pop": 19942, "state": "AL"},
    {"_id": "6", "city": "Faro", "loc": None, "pop": None, "state": None},
]


@pytest.fixture(scope="module")
def db(spark):
    out = Database(spark, f"tests_{uuid.uuid4().hex}")
    out["zips"].insert_many(PLACES)
    yield out
    out.drop()


def ids(df):
    return sorted(r["_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("filter", "expected"),
    [
        ({}, "123456"),
        ({"state": "AL"}, "125"),
        ({"state": {"$ne": "AL"}}, "34"),
        ({"state": {"$nin": ["AL"]}}, "346"),
        ({"pop": {"$gt": 10000}}, "245"),
        ({"pop": {"$gt": 10000.5}}, "245"),
        ({"pop": 6055.0}, "1"),
        ({"pop": 6055.5}, ""),
        ({"pop": {"$ne": 6055.5}}, "12345"),
        ({"pop": {"$lt": 1 << 70}}, "12345"),
        ({"pop": {"$gt": float("nan")}}, ""),
        ({"pop": "6055"}, ""),
        ({"pop": None}, "6"),
        ({"pop": {"$exists": False}}, "6"),
        ({"zip": {"$exists": False}}, "123456"),
        ({"zip": None}, "123456"),
        ({"zip": {"$not": {"$gt": 1}}}, "123456"),
        ({"loc": {"$gt": 34}}, "34"),
        ({"loc": {"$all": [-86.5, 33.1]}}, "1"),
        ({"loc": [-86.5, 33.1]}, "1"),
        ({"loc": {"$size": 2}}, "12345"),
        ({"loc.1": {"$lt": 33}}, "5"),
        ({"loc": {"$elemMatch": {"$gt": 33, "$lt": 34}}}, "12"),
        ({"loc": {"$in": [34.2, 32.9]}}, "35"),
        ({"city": re.compile("^[AB]")}, "12"),
        ({"city": {"$regex": "^d", "$options": "i"}}, "4"),
        ({"city": {"$in": ["Colm", re.compile("^F")]}}, "36"),
        ({"pop": {"$mod": [1000, 55]}}, "1"),
        ({"$or": [{"pop": {"$gt": 1, "$lt": 5000}}, {"city": "Dorn"}]}, "34"),
        ({"$or": [{"city": "Dorn"}, {"pop": {"$gt": 1, "$lt": 5000}}]}, "34"),
        ({"$nor": [{"state": "AL"}, {"state": "GA"}]}, "6"),
        ({"$and": [{"state": "AL"}, {"$or": [{"pop": {"$lte": 6055}}, {"pop": {"$gte": 19942}}]}]}, "15"),
        ({"loc": {"$geoWithin": {"$center": [[-86.5, 33.1], 0.7]}}}, "125"),
        ({"state": {"$type": "string"}}, "12345"),
        ({"pop": {"$type": [18]}}, "12345"),
        ({"$where": "pop % 2 = 0"}, "245"),
    ],
)
def test_find(db, filter, expected):
    assert "".join(ids(db["zips"].find(filter))) == expected


def test_find_order_and_projection(db):
    rows = db["zips"].find({"pop": {"$gt": 1}}, {"city": 1}, sort={"pop": -1}, skip=1, limit=2).collect()
    assert [r.asDict() for r in rows] == [{"_id": "4", "city": "Dorn"}, {"_id": "2", "city": "Birk"}]
    near = db["zips"].find({"loc": {"$near": [-86.0, 33.0]}}, {"_id": 1}, limit=2).collect()
    assert [r["_id"] for r in near] == ["5", "1"]
    assert db["zips"].find({"loc": {"$gt": 34}}, {"loc.$": 1, "_id": 0}).distinct().count() == 2
    assert db["zips"].find({}, {"_id": 0, "loc": {"$slice": -1}}).columns == ["city", "loc", "pop", "state"]


def test_group(db):
    rows = db["zips"].aggregate([{"$group": {"_id": "$state", "pop": {"$sum": "$pop"}, "n": {"$sum": 1}, "most": {"$max": "$pop"}, "mean": {"$avg": "$pop"}}}, {"$sort": {"pop": 1}}]).collect()
    assert [tuple(r) for r in rows] == [("GA", 17423.0, 2.0, 14218.0, 8711.5), ("AL", 36613.0, 3.0, 19942.0, 36613 / 3)]
    assert db["zips"].aggregate({"$group": {"_id": None, "n": {"$sum": 1}}}).collect()[0]["n"] == 6.0
    assert db["zips"].aggregate({"$group": {"_id": "$absent", "n": {"$sum": 1}}}).count() == 0
    assert db["zips"].aggregate({"$group": {"_id": "$state", "x": {"$sum": "$absent"}}}).where("x is null").count() == 2


def test_large_group(spark):
    df = spark.range(999_999).select(F.lit("g").alias("g"), F.lit(2).alias("v"), *(F.lit(k).alias(f"f{k}") for k in range(7)))
    assert [tuple(r) for r in aggregated(df, {"$group": {"_id": "$g", "s": {"$sum": "$v"}}}).collect()] == [("g", 1_999_998.0)]
    scope = of_schema(df.schema)
    assert df.where(compiled({"v": {"$ne": 2, "$gte": 2}}, scope)).count() == 0


def test_nested_projection(spark):
    df = spark.createDataFrame([((1, ("x", 2)), [("a", 1), ("b", 2)])], "s struct<a:int,b:struct<c:string,d:int>>, list array<struct<k:string,v:int>>")
    assert projected(df, {"s.b.c": 1, "list.v": 1}).collect()[0].asDict(True) == {"s": {"b": {"c": "x"}}, "list": [{"v": 1}, {"v": 2}]}
    assert projected(df, {"s.b": 0}).schema["s"].dataType.names == ["a"]
    scope = of_schema(df.schema)
    assert df.where(compiled({"list.k": "b", "s.b.d": {"$gte": 2}, "list": {"$elemMatch": {"k": "a", "v": 1}}}, scope)).count() == 1
    assert df.where(compiled({"list": {"$elemMatch": {"k": "a", "v": 2}}}, scope)).count() == 0
    assert df.where(compiled({"s": {"a": 1, "b": {"c": "x"}}}, scope)).count() == 1


def test_insert_evolves(db):
    coll = db["grows"]
    coll.drop()
    assert coll.insert_many([{"a": 1}, {"a": 2, "b": "x"}]) == 2
    assert coll.insert_many([{"a": 2.5, "c": {"d": [1, 2]}}]) == 1
    assert coll.insert_many([{"a": 4, "when": dt.datetime(2020, 1, 2, tzinfo=dt.timezone.utc), "raw": b"\x01"}]) == 1
    assert sorted(r["a"] for r in coll.find().collect()) == [1.0, 2.0, 2.5, 4.0]
    assert coll.count({"c.d": 2}) == 1 and coll.count({"when": {"$gt": dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)}}) == 1
    with pytest.raises(RequestError):
        coll.insert_many([{"a": "text"}])
    assert coll.update_many({"a": {"$lt": 3}}, {"$set": {"b": "small", "n": 7}, "$inc": {"a": 10}}) == 3
    assert coll.count({"b": "small", "n": 7, "a": {"$gt": 10}}) == 3
    assert coll.delete_many({"b": "small"}) == 3 and coll.count() == 1


def test_dynamic(db):
    coll = db["mixed"]
    coll.drop()
    coll.insert_many([{"a": 1, "k": "x"}, {"a": "1"}, {"a": [1, 5]}, {"a": 2.5}, {"a": None}, {"b": {"c": True}}], dynamic=True)
    assert coll.count({"a": 1}) == 2 and coll.count({"a": "1"}) == 1 and coll.count({"a": {"$gt": 1.5}}) == 2
    assert coll.count({"a": {"$exists": True}}) == 5 and coll.count({"a": None}) == 2 and coll.count({"b.c": True}) == 1
    assert coll.count({"a": {"$type": "string"}}) == 1 and coll.count({"a": {"$size": 2}}) == 1
    assert [tuple(r) for r in coll.aggregate({"$group": {"_id": "$k", "s": {"$sum": "$a"}}}).collect()] == [("x", 1.0)]


def test_save_load_compare(db, tmp_path):
    path = str(tmp_path / "zips")
    db["zips"].save(path)
    again = db.load("zips2", path)
    assert db["zips"].compare(again) == (True, "")
    again.delete_many({"state": "AL"})
    assert db["zips"].compare(again)[0] is False and "zips2" in db.collection_names()
    assert db.of_namespace(f"{db.name}.zips").count() == 6
    with pytest.raises(RequestError):
        db["nowhere"].find()
    with pytest.raises(RequestError):
        db.of_namespace(f"{db.name}s.zips")


def test_cursor(db):
    cursor = Cursor(db["zips"].find(sort={"_id": 1}), batch_size=4)
    first, second = cursor.next_batch(), cursor.next_batch(-4)
    assert [d["_id"] for d in first + second] == list("123456") and "pop" not in second[-1]
    assert cursor.exhausted and cursor.next_batch() == []


def test_commands(db):
    s = Session(db)
    assert s.run({"ping": 1}) == {"ok": 1.0} and s.run({"isMaster": 1})["ismaster"]
    for name in ("buildinfo", "getLog", "getlasterror", "whatsmyuri", "replSetGetStatus"):
        assert "ok" in s.run({name: 1})
    db["cmd"].drop()
    assert s.run({"insert": "cmd", "documents": [{"x": i} for i in range(5)]}) == {"ok": 1.0, "n": 5}
    out = s.run({"find": "cmd", "filter": {"x": {"$gte": 1}}, "sort": {"x": 1}, "batchSize": 3})
    assert [d["x"] for d in out["cursor"]["firstBatch"]] == [1, 2, 3]
    more = s.run({"getMore": out["cursor"]["id"], "collection": "cmd"})
    assert [d["x"] for d in more["cursor"]["nextBatch"]] == [4] and more["cursor"]["id"] == 0
    out = s.run({"aggregate": "cmd", "pipeline": [{"$group": {"_id": None, "s": {"$sum": "$x"}}}]})
    assert out["cursor"]["firstBatch"] == [{"s": 10.0}]
    assert s.run({"count": "cmd", "query": {"x": 3}})["n"] == 1
    assert sorted(s.run({"distinct": "cmd", "key": "x"})["values"]) == [0, 1, 2, 3, 4]
    assert s.run({"update": "cmd", "updates": [{"q": {"x": 0}, "u": {"$set": {"x": 9}}}]})["n"] == 1
    assert s.run({"delete": "cmd", "deletes": [{"q": {"x": {"$gt": 3}}}]})["n"] == 2
    out = s.run({"find": "cmd", "batchSize": 1})
    assert s.run({"killCursors": "cmd", "cursors": [out["cursor"]["id"], 0]})["cursorsKilled"] == [out["cursor"]["id"]]
    for bad in ({"mapReduce": 1}, {}, {"getMore": 12345}):
        with pytest.raises(RequestError):
            s.run(bad)


@pytest.mark.parametrize("bad", [{"$foo": 1}, {"a": {"$foo": 1}}, {"$or": []}, {"a": {"$in": 3}}, {"a": {"$mod": [0, 1]}}, {"a": {"$gt": 1, "b": 2}}, {"a": {"$options": "i"}}, {"a": {"$regex": "x", "$options": "q"}}, {"$where": 3}, "text"])
def test_bad_filters(spark, bad):
    with pytest.raises(RequestError):
        compiled(bad, of_schema(T.StructType().add("a", "long")))


@pytest.mark.parametrize("bad", [[{"$lookup": {}}], [{"$group": {"_id": "$a"}}], [{"$group": {"n": {"$sum": 1}}}], [{"$group": {"_id": "$a", "n": {"$foo": 1}}}], [{"$match": {}, "$sort": {}}], [{"$limit": 0}], [{"$sort": {"a": 2}}]])
def test_bad_pipelines(spark, bad):
    with pytest.raises(RequestError):
        aggregated(spark.range(1).withColumnRenamed("id", "a"), bad)


def test_bad_projection(spark):
    with pytest.raises(RequestError):
        projected(spark.range(1).selectExpr("id as a", "id as b"), {"a": 1, "b": 0})


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_id": {"$oid": "5a"}, "n": {"$numberLong": "7"}, "at": {"$date": 1000}, "in": {"x": {"$oid": "b"}}}\n')
    row = read_json(spark, str(tmp_path / "a.json")).collect()[0].asDict(True)
    assert (row["_id"], row["n"], row["in"]) == ("5a", 7, {"x": "b"}) and row["at"].timestamp() == 1.0
    assert decoded({"a": [{"$date": {"$numberLong": "1000"}}, {"$binary": {"base64": "AQ==", "subType": "00"}}]})["a"][1] == b"\x01"
    (tmp_path / "b.csv").write_text("A,B\n1,x\n,\n")
    df = read_csv(spark, str(tmp_path / "b.csv"), "A int, B string")
    assert df.where(compiled({"A": {"$exists": True}}, of_schema(df.schema))).count() == 1
    (tmp_path / "c.json").write_text('{"a": 1}\nnot json\n{"a": "x"}\n')
    df = read_dynamic(spark, str(tmp_path / "c.json"))
    assert df.where(compiled({"a": "x"}, of_schema(df.schema, "doc"))).count() == 1
    assert to_json(spark.range(1)).collect()[0]["value"] == '{"id":0}'


def test_streaming(spark, tmp_path):
    from docloom.streaming.follow import followed

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1}\n{"a": 5}\n')
    q = followed(spark, str(tmp_path / "in"), "a long", {"a": {"$gt": 2}}).writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    q.stop()
    assert [r["a"] for r in spark.table("followed").collect()] == [5]


def test_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows = projected(df.where(compiled({"l_linenumber": {"$gt": 2.5}, "l_returnflag": {"$in": ["A", "R"]}}, of_schema(df.schema))), {"l_orderkey": 1})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_linenumber,2)" in plan and "In(l_returnflag" in plan
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>", plan)
    plan = aggregated(df, {"$group": {"_id": "$l_returnflag", "q": {"$sum": "$l_quantity"}, "n": {"$sum": 1}}})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "partial_sum" in plan


# Random filters against a plain evaluator

FIELDS = {"i": [None, 0, 1, 2, 5], "d": [None, 0.5, 1.0, 2.0], "s": [None, "a", "b", "ab"], "l": [None, [], [1], [1, 5], [2, 2]]}


def random_filter(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.45:
        return {rng.choice(["$and", "$or", "$nor"]): [random_filter(rng, depth + 1) for _ in range(rng.randint(1, 3))]}
    if depth < 3 and kind < 0.55:
        return random_leaf(rng) | random_leaf(rng)
    return random_leaf(rng)


def random_leaf(rng):
    field = rng.choice(list(FIELDS))
    value = lambda: rng.choice([0, 1, 1.5, 2, 2.0, "a", "b", None])
    op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$not", "$exists", "bare"])
    if op == "bare":
        return {field: value()}
    if op in ("$in", "$nin"):
        return {field: {op: [value() for _ in range(rng.randint(0, 3))]}}
    if op == "$not":
        return {field: {"$not": {rng.choice(["$gt", "$eq"]): value()}}}
    return {field: {op: rng.random() < 0.5 if op == "$exists" else value()}}


def holds(f, doc):
    return all(entry_holds(k, v, doc) for k, v in f.items())


def entry_holds(k, v, doc):
    if k == "$and":
        return all(holds(x, doc) for x in v)
    if k == "$or":
        return any(holds(x, doc) for x in v)
    if k == "$nor":
        return not any(holds(x, doc) for x in v)
    ops = v if isinstance(v, dict) else {"$eq": v}
    return all(op_holds(op, arg, doc[k]) for op, arg in ops.items())


def op_holds(op, arg, x):
    if op == "$not":
        return not all(op_holds(o, a, x) for o, a in arg.items())
    if op == "$exists":
        return (x is not None) == arg
    if op == "$in":
        return any(op_holds("$eq", a, x) for a in arg)
    if op == "$nin":
        return not op_holds("$in", arg, x)
    if arg is None:
        return (x is None) if op == "$eq" else (x is not None) if op == "$ne" else False
    if isinstance(x, list):
        return any(op_holds(op, arg, e) for e in x)
    if x is None or isinstance(x, str) != isinstance(arg, str):
        return False
    return {"$eq": x == arg, "$ne": x != arg, "$gt": x > arg, "$gte": x >= arg, "$lt": x < arg, "$lte": x <= arg}[op]


def test_random_filters(spark):
    rng = random.Random(3)
    docs = [{"n": n, **{k: rng.choice(v) for k, v in FIELDS.items()}} for n in range(150)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "n int, i int, d double, s string, l array<int>").coalesce(1).cache()
    filters = [random_filter(rng) for _ in range(120)]
    scope = of_schema(df.schema)
    found = df.select("n", *(F.coalesce(compiled(f, scope), F.lit(False)).alias(f"c{k}") for k, f in enumerate(filters))).collect()
    for row in found:
        for k, f in enumerate(filters):
            assert row[f"c{k}"] == holds(f, docs[row["n"]]), (f, docs[row["n"]])
