"""Very long texts, many matches, hot ids and many shards: results against plain versions, each in bounded time."""

import gzip
import math
import random
import time
import zlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_contracts import base_spans, check_line_dedup, check_pii, fingerprint, rows_of

from docloom.llm import bpe, common, fingerprints, linededup, packing, pii, sharding, simhash, toxicity, vectors, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = 1_200_000
RUNS = {"blanks": " " * LONG, "breaks": "\n" * LONG, "letters": "x" * LONG, "digits": "7" * LONG, "signs": "^" * LONG, "words": "some words " * (LONG // 11)}


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(RUNS.values())], "doc_id long, text string").repartition(4).cache()


def in_time(seconds, run):
    began = time.monotonic()
    out = run()
    assert time.monotonic() - began < seconds
    return out


def test_packing_long_runs(runs):
    got = in_time(90, lambda: packing.pack(runs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"), F.max("length").alias("most")).collect())
    t = bpe.tokenizer(PATH)
    expected = {i: len(t.encode(x)) + 1 for i, x in enumerate(RUNS.values())}
    assert {r["doc_id"]: r["n"] for r in got} == {r["doc_id"]: r["m"] for r in got} == expected


def test_encoder_cuts(monkeypatch):
    """Texts cut into short segments have the ids of whole ones."""
    rng = random.Random(3)
    monkeypatch.setattr(packing, "SEGMENT", 20)
    encode, t = packing.encoder.__wrapped__(PATH), bpe.tokenizer(PATH)
    alphabet = [" ", "  ", "\n", "\n\n", "\t", " ", "\x1c", "\x85", "a", "b'll", "don't", "7", "42", "é", "🙂", "!?", "<|endoftext|>", "'s", "漢字", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert encode(text).tolist() == t.encode(text), text
    assert "".join(packing.segments("ab  cd \n" * 50)) == "ab  cd \n" * 50 and max(map(len, packing.segments("ab  cd \n" * 50))) < 30


def test_bpe_long_runs(runs):
    out = in_time(90, lambda: rows_of(bpe.encoding_digests(runs, PATH), "doc_id"))
    t = bpe.tokenizer(PATH)
    assert all(out[i]["n_tokens"] == len(t.encode(x)) for i, x in enumerate(RUNS.values()))


def test_other_operators_on_long_runs(runs):
    texts = list(enumerate(RUNS.values()))
    out = in_time(90, lambda: rows_of(fingerprints.edited_fingerprints(runs), "doc_id"))
    assert [out[i]["n_chars"] for i, _ in texts] == [len(x) for _, x in texts]
    out = in_time(90, lambda: rows_of(simhash.simhash_groups(runs), "doc_id"))
    assert [out[i]["fp"] & (2**64 - 1) for i, _ in texts] == [fingerprint(x) for _, x in texts]
    out = in_time(90, lambda: rows_of(simhash.similar_groups(runs), "doc_id"))
    assert [out[i]["component_id"] for i, _ in texts] == [0, 0, 2, 3, 4, 5]
    out = in_time(90, lambda: rows_of(linededup.without_repeats(runs), "doc_id"))
    assert all((out[i]["text"], out[i]["n_removed"]) == (x, 0) for i, x in texts)
    assert len(in_time(90, lambda: rows_of(sharding.sharded(runs, shards=3), "doc_id"))) == len(texts)
    out = in_time(90, lambda: rows_of(pii.span_digests(runs), "doc_id"))
    assert all(out[i]["spans"] == "" for i, _ in texts)
    chain = toxicity.Chain(["a"], [toxicity.Linear(0.0, {"words": 1.0}, [])])
    out = in_time(90, lambda: rows_of(toxicity.scored(runs, chain, prefix="p_").drop("text"), "doc_id"))
    assert [out[i]["p_a"] > 0.5 for i, _ in texts] == [False] * 5 + [True]


def test_line_dedup_blank_lines(spark):
    """Passages behind and among very many lines without words."""
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    blank = "\n" * 300_000
    texts = [(1, f"{blank}{a}\n\n{b}"), (2, f"own\n\n{a}\n\n{b}{blank}end"), (3, f"{a}{blank}{b}"), (4, f"x\n{a}{blank}{b}"), (5, f"{a}\n{b}")]
    out = in_time(60, lambda: rows_of(linededup.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id"))
    assert [out[i]["removed"] for i, _ in texts] == ["", "1:5", "", "1:300002", ""]


def test_line_dedup_long_texts(spark):
    """One text quotes very many others, and very many quote one: what moves is about the quoted lines."""
    n = 3000
    passages = [" ".join(f"p{k}w{j}" for j in range(25)) + "\n" + " ".join(f"q{k}w{j}" for j in range(26)) for k in range(2 * n)]
    shared = "\n".join(passages[n:])
    texts = [(k, f"own {k}\n{passages[k]}\nend") for k in range(n)]
    texts += [(n, "\n".join(passages[:n])), (n + 1, shared), *((n + 2 + k, f"x {k}\n{passages[n + k]}") for k in range(n))]
    out = in_time(90, lambda: rows_of(linededup.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id"))
    assert all(out[k]["removed"] == "" for k in range(n)) and out[n + 1]["text"] == shared
    assert out[n]["text"] == "" and out[n]["n_removed"] == out[n]["n_lines"] == 2 * n
    assert all(out[n + 2 + k]["text"] == f"x {k}" for k in range(n))


def test_line_dedup_dealt(spark, monkeypatch):
    """A passage that every text has, at various depths and twice in some: the same with hot keys dealt into chunks."""
    rng = random.Random(8)
    line = lambda tag: " ".join(f"{tag}{j}" for j in range(30))
    passage = "\n".join(line(t) for t in "abcde")
    texts = []
    for i in range(200):
        own = [line(f"own{i}x{k}x") for k in range(rng.randint(0, 4))]
        own.insert(rng.randint(0, len(own)), passage if i % 3 else "\n".join(line(t) for t in "bcd"))
        texts.append((i, "\n".join(own + [passage] * (i % 5 == 0))))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    plain = rows_of(linededup.without_repeats(df), "doc_id")
    assert check_line_dedup(plain, texts) > 500
    monkeypatch.setattr(linededup, "dealt_join", partial(common.dealt_join, chunk=3))
    assert rows_of(linededup.without_repeats(df), "doc_id") == plain


def test_dealt_join(spark, monkeypatch):
    """Hot keys, keys on one side only, null keys and repeated rows: the rows of the plain join."""
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, 7, None, *range(30)]), rng.randint(0, 50)) for _ in range(2000)]
    many = spark.createDataFrame(rows, "k int, v int")
    one = spark.createDataFrame([(k, f"s{k}") for k in (7, None, *range(20, 40))], "k int, s string")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    expected = sorted(tuple(r) for r in many.join(one, "k").collect())
    for most, hot in ((4096, 1024), (10, 1024), (1, 4)):
        monkeypatch.setattr(common, "HOT", hot)
        got = common.dealt_join(many, one, counts, ["k"], ["v"], chunk=most)
        assert got.columns == ["k", "v", "s"] and sorted(tuple(r) for r in got.collect()) == expected
    assert common.dealt_join(many.limit(0), one, counts.limit(0), ["k"], ["v"]).count() == 0


def test_simhash_shorter_segments(spark, monkeypatch):
    """Cells of one-bit segments, which very many fingerprints get, link the same."""
    assert [simhash.segment_for(n) for n in (0, 10**6, 2 * 10**7, 10**8, 10**11)] == [2, 2, 2, 1, 1]
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts = [[rng.choice(words) for _ in range(120)] for _ in range(60)]
    texts += [[w if rng.random() > 0.01 else rng.choice(words) for w in rng.choice(texts)] for _ in range(300)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").cache()
    coarse = rows_of(simhash.simhash_groups(df), "doc_id")
    assert len({r["component_id"] for r in coarse.values()}) < len({r["fp"] for r in coarse.values()}) - 50
    monkeypatch.setattr(simhash, "CANDIDATES", 0)
    assert rows_of(simhash.simhash_groups(df), "doc_id") == coarse


@pytest.mark.parametrize("glue", [" ", "\n", ", "])
def test_pii_many_matches(spark, glue):
    """More matches than a chunk holds, of all kinds, in one text; and a text of a megabyte in time."""
    rng = random.Random(5)
    kinds = [lambda k: f"u{k}@ab{k}.cd", lambda k: f"10.{k % 300}.3.4", lambda k: "4111 1111 1111 1111", lambda k: f"+49 30 {1000000 + k}", lambda k: "DE89370400440532013000", lambda k: "ssn 078-05-1120", lambda k: "é" * (k % 7)]
    text = glue.join(rng.choice(kinds)(k) for k in range(4 * pii.CHUNK))
    docs = [(1, text), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = rows_of(pii.span_digests(df), "doc_id")
    assert check_pii(out, docs) > pii.CHUNK
    spans = sorted((int(s), int(e), kind) for kind, s, e in (x.split(":") for x in out[1]["spans"].split(",")))
    plain, at = "", 0
    for s, e, kind in spans:
        if s >= at:
            plain += text[at:s] + f"<{kind.upper()}>"
        at = max(at, e)
    # Of spans that begin at one place the order of kinds decides; here they don't.
    assert len({s for s, _, _ in spans}) == len(spans)
    assert pii.redacted(df).where("doc_id = 1").first()["text"] == plain + text[at:]


def test_pii_in_proportion(spark):
    text = " ".join(f"u{k}@ab.cd" for k in range(80_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert in_time(30, lambda: pii.span_digests(df).first())["n_email"] == 80_000 == len(base_spans(text))


def plain_best_fit(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= size]
        if fits:
            bins[min(fits, key=lambda k: (bins[k], k))] -= size
        else:
            bins.append(capacity - size)
    return sorted(capacity - left for left in bins)


def test_sharding_is_best_fit(spark):
    """Loads of shards against best fit over the groups themselves."""
    rng = random.Random(11)
    texts = [(i, f"{rng.randrange(300)} " * rng.randint(1, 40)) for i in range(3000)]
    groups = Counter()
    for _, x in texts:
        groups[x] += len(x) + 1
    capacity = 40_000
    out = rows_of(sharding.sharded(spark.createDataFrame(texts, "doc_id long, text string"), shards=None, capacity=capacity), "doc_id")
    loads, places = Counter(), {}
    for i, x in texts:
        loads[out[i]["shard"]] += out[i]["size"]
        assert places.setdefault(x, out[i]["shard"]) == out[i]["shard"]
    assert sorted(loads.values()) == plain_best_fit(groups.values(), capacity)


def test_sharding_of_one_id(spark):
    """Rows that repeat one id and text are dealt like others, and many rows of a short text don't crowd a task."""
    hot = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    out = sharding.sharded(hot).groupBy("shard").agg(F.sum("size").alias("b"), F.countDistinct("slot").alias("n"), F.max("slot").alias("last")).collect()
    assert len(out) == 16 and max(r["b"] for r in out) <= 1.1 * 2000 * 14 / 16 and all(r["last"] == r["n"] - 1 for r in out)


def test_sharding_into_many(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    out = sharding.sharded(df, shards=None, capacity=60).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("last"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["b"] for r in out)
    assert len(out) > 4096 and max(r["b"] for r in out) <= 60 and len(out) <= 1.15 * total / 60 and all(r["last"] == r["n"] - 1 for r in out)
    with pytest.raises(ValueError, match="doesn't fit"):
        sharding.sharded(df, shards=None, capacity=8)


def test_toxicity_bounds(spark, monkeypatch):
    """Repeated ids, and words beyond the bound: what comes to the driver stays within both limits."""
    rows = [(1, f"text number {k}") for k in range(3000)] + [(i, f"other {i} " * 5) for i in range(2, 40)] + [(None, "no id"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 51)] + [(1, 0, 1), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    seen = []
    whole = toxicity.Sample.of
    monkeypatch.setattr(toxicity.Sample, "of", classmethod(lambda cls, texts: whole(seen.append(list(map(list, texts))) or seen[-1])))
    chains = [toxicity.train(docs, labels, toxicity.CATEGORIES) for _ in range(2)]
    assert [len(x) for x in seen] == [40, 40] and chains[0] == chains[1]
    toxicity.train(docs, labels, toxicity.CATEGORIES, max_labelled=2)
    assert len(seen[2]) <= 2
    toxicity.train(docs, labels, toxicity.CATEGORIES, max_bytes=200)
    assert 0 < sum(len(w) for x in seen[3] for w in x) <= 200
    assert toxicity.train(docs.limit(0), labels, toxicity.CATEGORIES).log_odds("text") == [0.0, 0.0]


def plain_logistic(x, y, used, unpenalised, penalty=0.3):
    """Newton's method for the same loss: classes weigh alike, L2 on all columns but the last."""
    share = y[used].mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * used
    ridge = np.full(x.shape[1], penalty)
    ridge[unpenalised] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w, x @ w + math.log(share / (1 - share))


def test_toxicity_chain_by_hand(monkeypatch):
    """The chain's predictions on new texts, with fits run to their end, against each link fitted by Newton's method with folds left out by hand."""
    stopped = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda *args: stopped(*args, steps=6000))
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(40)]

    def drawn(n):
        texts, labels = [], []
        for _ in range(n):
            words = {w for w in vocabulary if rng.random() < 0.3}
            low = int(len(words & set(vocabulary[:8])) + rng.random() > 3)
            toxic = int(2 * low + len(words & set(vocabulary[8:14])) + rng.random() > 3.2)
            texts.append(sorted(words))
            labels.append((low, toxic))
        return texts, np.array(labels)

    texts, labels = drawn(500)
    folds = np.arange(500) % toxicity.FOLDS
    chain = toxicity.fit_chain(toxicity.Sample.of(texts), labels, ["low", "toxic"], folds)
    new, _ = drawn(200)
    matrix = lambda rows: np.array([[w in set(r) for w in vocabulary] for r in rows], dtype=float)
    x, z = matrix(texts), matrix(new)
    one = lambda m: np.column_stack([m, np.ones(len(m))])
    y, everything = labels[:, 0].astype(float), np.ones(500, dtype=bool)
    outside = np.zeros(500)
    for fold in range(toxicity.FOLDS):
        odds = plain_logistic(one(x), y, folds != fold, -1)[1]
        outside[folds == fold] = np.clip(odds, -toxicity.CLIP, toxicity.CLIP)[folds == fold]
    first, _ = plain_logistic(one(x), y, everything, -1)
    shift = lambda y: math.log(y.mean() / (1 - y.mean()))
    low = np.clip(one(z) @ first + shift(y), -toxicity.CLIP, toxicity.CLIP)
    second, _ = plain_logistic(one(np.column_stack([x, outside])), labels[:, 1].astype(float), everything, -1)
    toxic = np.clip(one(np.column_stack([z, low])) @ second + shift(labels[:, 1]), -toxicity.CLIP, toxicity.CLIP)
    got = np.array([[m for m in chain.log_odds(" ".join(r))] for r in new])
    p = lambda v: 1 / (1 + np.exp(-v))
    assert np.abs(p(got[:, 0]) - p(low)).max() < 0.01
    assert np.abs(p(got[:, 1]) - p(toxic)).max() < 0.01


def test_toxicity_held_out(spark):
    """Labelled documents that the chain wasn't fitted on."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(4)) == 0
    chain = toxicity.train(docs, labels.where(~held), toxicity.CATEGORIES)
    out = toxicity.scored(docs.select("doc_id", "text").join(labels.where(held), "doc_id"), chain).select("toxic", "p_toxic").collect()
    toxic = [r["p_toxic"] >= toxicity.THRESHOLD for r in out if r["toxic"] == 1]
    clean = [r["p_toxic"] >= toxicity.THRESHOLD for r in out if r["toxic"] == 0]
    assert len(toxic) > 10 and np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.01


def test_canonical_is_stable(spark):
    """Letters that folding takes apart meet their composed forms."""
    pairs = [("\u01f0\u0323", "J\u0323\u030c"), ("\u0390", "\u0399\u0308\u0301"), ("ﬃ", "FFI"), ("ß", "SS"), ("Ǆ", "dž")]
    rows = [(k, x) for k, p in enumerate(pairs) for x in p]
    got = spark.createDataFrame(rows, "k int, text string").select("k", fingerprints.canonical(F.col("text")).alias("c")).distinct().collect()
    assert len(got) == len(pairs)


def members(path):
    """The gzip members of a file, each inflated by itself."""
    data, out = path.read_bytes(), []
    while data:
        inflate = zlib.decompressobj(31)
        out.append(inflate.decompress(data) + inflate.flush())
        data = inflate.unused_data
    return out


def test_warc_members(spark, tmp_path):
    """Each record is a member; plain, whole and foreign archives read the same; ids of any type come back."""
    pages = [(f"page {k}/é", f"http://h/{k}", "<p>" + "x" * (k % 50) * 20 + "</p>") for k in range(300)] + [("", "u", "none"), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string").repartition(3)
    path = tmp_path / "archive"
    warc.write_warc(df, str(path))
    files = sorted(path.glob("*.warc.gz"))
    assert [p.name for p in path.iterdir() if p not in files] == [] and len(files) == 3
    found = [m for f in files for m in members(f)]
    assert len(found) == len(pages) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC-Type") == 1 for m in found)
    for m in found:
        head, _, block = m[:-4].partition(b"\r\n\r\n")
        assert int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"]) == len(block)
    expected = sorted(map(str, warc.read_warc(spark, str(path)).collect()))
    for name, data in (("plain", b"".join(found)), ("whole", gzip.compress(b"".join(found)))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        assert sorted(map(str, warc.read_warc(spark, str(tmp_path / name)).collect())) == expected
        assert warc.read_warc(spark, str(tmp_path / name), "record_type string").where("record_type = 'revisit'").count() == sum(b"WARC-Type: revisit" in m for m in found)
    out = rows_of(warc.archived(df), "page_id")
    assert out.keys() == {p[0] for p in pages}
    smallest = {}
    for i, _, html in pages:
        if i is not None and len(html) >= 100:
            smallest[html] = min(i, smallest.get(html, i))
    for i, _, html in pages:
        first = smallest.get(html, i)
        assert (out[i]["record_type"], out[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))


def test_warc_skips_undecoded(monkeypatch, tmp_path):
    """Of records that aren't wanted, no more than the first bytes are inflated."""
    rng = random.Random(1)
    block = bytes(rng.randrange(256) for _ in range(300_000))
    record = lambda kind: b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind, len(block)) + block + b"\r\n\r\n"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(warc.member(record(b"request" if k % 4 else b"response")) for k in range(20)))
    inflated = []
    whole = warc.Stream.inflated
    monkeypatch.setattr(warc.Stream, "inflated", lambda self: (inflated.append(whole(self)), inflated[-1])[1])
    got = list(warc.records(str(path), [("warc-type", frozenset(["response"]))], True))
    assert [b for _, b in got] == [block] * 5
    assert sum(map(len, inflated)) < 5 * 300_000 + 20 * 70_000


def test_vector_sides_are_exact():
    """Sides are the same whatever is computed together with a vector, so that pairs count once."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 24)).astype(np.float32).astype(np.float64) * np.exp(rng.normal(0, 20, 300))[:, None]
    normals = vectors.planes_of(24, 5, 7, 3)
    whole = vectors.sides_of(x, normals, 5)
    for k in range(0, 300, 7):
        assert (vectors.sides_of(x[k : k + 1], normals[:, : 3 * 5], 5) == whole[k : k + 1, :3]).all()


def test_vectors_in_production_tables(spark):
    """Hot vectors and near copies through large buckets, against brute force."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 16))
    x = np.concatenate([base, np.repeat(base[:5], 200, axis=0) + rng.normal(0, 0.12, (1000, 16)), np.repeat(base[:1], 500, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = rows_of(vectors.near_vectors(df), "vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links = near.sum(axis=1) - 1
    assert sum(out[i]["n_links"] for i in range(len(x))) >= 0.999 * links.sum() and all(out[i]["n_links"] <= links[i] for i in range(len(x)))
