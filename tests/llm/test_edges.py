"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_contracts import canonical, check_line_dedup, check_packing, check_pii, check_sharding, check_warc, components, fingerprint, rows_of
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm.common import cut
from docloom.llm import bpe, fingerprints, linededup, packing, pii, sharding, simhash, toxicity, vectors, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
_RNG = random.Random(5)
LONG = "".join(_RNG.choice("abcde  \n") for _ in range(60_000))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, LONG), (4, "x" * 30_000), (5, "Same text, twice."), (6, "Same text, twice."), (7, "same  TEXT,\ntwice."),
    (8, "ﬁne Straße É"), (9, "fine STRASSE É"), (300, "9" * 20_000), (301, "a." * 10_000), (302, "call +49 (30) 1234567 or mail a@b.c_x@d.e @f.g 1.2.3.4.5 4111 1111 1111 1111-"),
    (303, "+" * 5000 + "1 2" * 5000), (304, "🙂 a@b.co 🙂 999.1.1.1 001.002.003.255"), (305, "<|endoftext|> and ' s 's"), (70_000, "the last one far away"), (70_000_000_000, "and farther"),
]
EXTRA = "id long, text string, n int, fingerprint string, group_id int, check int, fp int, cell int, n_lines string, removed int, pii string, shard int, size int, p_toxic string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    """The texts, with columns whose names operators use themselves."""
    rows = [(i, x, *([None] * 13)) for i, x in TEXTS]
    return spark.createDataFrame(rows, EXTRA.replace("id long", "doc_id long", 1)).repartition(3)


@pytest.fixture(scope="module")
def plain():
    return [(i, x or "") for i, x in TEXTS]


def test_fingerprints(docs, plain):
    out = rows_of(fingerprints.edited_fingerprints(docs), "doc_id")
    for k, (i, x) in enumerate(plain):
        following = plain[(k + 1) % len(plain)][1]
        cut = len(x) // 4
        edited = x[: len(x) - cut] + following[:cut]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["near_edited"] == float(canonical(x) == canonical(edited))
    classes = {i: out[i]["group_id"] for i, _ in plain}
    assert [classes[i] for i in (0, 1, 2, 5, 6, 7, 8, 9)] == [0, 0, 0, 5, 5, 5, 8, 8]
    whole = fingerprints.fingerprints(docs)
    assert sorted(whole.columns) == sorted({*docs.columns, "fingerprint", "group_id", "group_size"} - {"check"}) and whole.count() == len(plain)
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.edited_fingerprints(docs.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_next_over_wide_ids(spark):
    rng = random.Random(2)
    ids = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)} | {rng.randrange(5000) for _ in range(300)})
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    out = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next_text(df).collect()}
    assert out == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_bpe(docs, plain):
    t = Tokenizer.from_file(PATH)
    out = rows_of(bpe.encoded(docs, PATH), "doc_id")
    for i, x in plain:
        assert out[i]["ids"] == t.encode(x, add_special_tokens=False).ids and out[i]["decoded"] == x
    assert bpe.encoding_digests(docs.limit(0), PATH).count() == 0


def test_simhash(spark, docs, plain):
    twice = docs.union(docs)
    out = simhash.simhash_groups(twice).collect()
    assert len(out) == 2 * len(plain)
    fps = [fingerprint(x) for _, x in plain]
    roots = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4])
    expected = {i: (fp, plain[r][0]) for (i, _), fp, r in zip(plain, fps, roots)}
    assert {(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in out} == {(i, *v) for i, v in expected.items()}
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_simhash_links_in_large_groups(spark, monkeypatch):
    """Chains and balls of fingerprints, through cells that are dealt into chunks and compared in blocks."""
    from docloom.llm import cells

    rng = random.Random(9)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(150):
            fps.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            x = y if rng.random() < 0.5 else x
            fps.add(y)
    fps = sorted(fps)
    array = np.array(fps, dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4)]
    roots = components(len(fps), pairs)
    df = spark.createDataFrame([(i, int(x) - (1 << 64) if x >> 63 else int(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    whole = simhash.linked
    for chunk in (4096, 16):
        def linked(least, chunk=chunk):
            placed = least.select("fp").mapInArrow(simhash.in_cells, "cell bigint, fp bigint")
            return cells.dealt_cells(placed, "cell", "fp", chunk).mapInArrow(simhash.linked_forest(4), "a bigint, b bigint")

        out = {r["doc_id"]: r["component_id"] for r in simhash.grouped(df, whole if chunk == 4096 else linked).collect()}
        assert out == dict(enumerate(roots))


def jaccard(a, b, words=5):
    def shingles(x):
        t = x.encode().lower().split()
        return {b" ".join(t[i : i + words]) for i in range(len(t) - words + 1)} or {b" ".join(t)}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_similar_groups(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    texts += ["", "  ", "one two", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    roots = components(len(texts), pairs)
    assert len(pairs) > 80
    assert sum(out[a] == out[b] for a, b in pairs) >= 0.995 * len(pairs)
    assert all(roots[i] == roots[c] for i, c in out.items())
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_similar_groups_in_a_template(spark):
    """Pairs among many texts of one template, whose fingerprints are as near but which share too little."""
    rng = random.Random(12)
    template = [f"w{rng.random():.6f}" for _ in range(400)]

    def changed(base, places):
        return [f"x{rng.random():.6f}" if k in places else x for k, x in enumerate(base)]

    texts = []
    for k in range(500):
        places = rng.sample(range(5, 395), 6)
        if k % 5:
            texts.append(" ".join(changed(template, places)))
        else:
            base = changed(template, places[:2])
            texts += [" ".join(changed(base, rng.sample(range(5, 395), 4))) for _ in range(2)]
    shingles = [{hash(tuple(t[i : i + 5])) for i in range(len(t) - 4)} for t in map(str.split, texts)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if 9 * len(shingles[a] & shingles[b]) >= 4 * (len(shingles[a]) + len(shingles[b]))]
    roots = components(len(texts), pairs)
    assert len(pairs) > 80 and len(set(roots)) > 100
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == dict(enumerate(roots))


def test_similar_groups_of_few_shingles(spark):
    """Sets of 4 and 5 shingles, whose bits differ more often than their cosine tells."""
    rng = random.Random(13)
    rows = []
    for k in range(400):
        words = [f"{rng.random():.9f}" for _ in range(9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {k: k - k % 2 for k, _ in rows}


@pytest.mark.parametrize("sides", [False, True])
def test_set_links(sides):
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 40, (3, 50)).astype(np.uint64)
    sets = []
    for k in range(80):
        x = base[k % 3][: rng.integers(20, 50)].copy()
        new = rng.random(len(x)) < rng.choice([0.02, 0.1, 0.2])
        x[new] = rng.integers(0, 1 << 40, new.sum())
        sets.append(np.unique(x))
    side = rng.integers(0, 2, 80) if sides else None
    near = [(a, b) for a in range(80) for b in range(a) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b])) and (not sides or side[a] != side[b])]
    links = simhash.set_links(sets, side, 0.8)
    assert components(80, near) == components(80, links) and {(max(x), min(x)) for x in links} <= set(near)


def test_similar_groups_count_shingles_once(spark):
    """A passage repeated over most of two texts makes them alike only as far as their sets of shingles are."""
    rng = random.Random(8)
    own = [" ".join(f"{rng.random():.9f}" for _ in range(40)) for _ in range(2)]
    rows = [(k, "la " * 400 + own[k]) for k in range(2)] + [(2, own[0]), (3, own[0] + " " + own[0])]
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a, b) for a in range(4) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    roots = components(4, pairs)
    assert out == {k: roots[k] for k in range(4)} and out[1] == 1


@pytest.mark.parametrize("n", [7, 40, simhash.HELD, simhash.HELD + 90])
def test_nearest_forests(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 256, (6, 32), dtype=np.uint8)
    fps = np.unpackbits(base[rng.integers(0, 6, n)], axis=1) ^ (rng.random((n, 256)) < 0.06)
    fps = np.unique(np.packbits(fps, axis=1), axis=0)
    raw = [x.tobytes() for x in fps]
    zero = pa.array(np.zeros(len(raw), dtype=np.int64))
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(raw, pa.binary())], ["cell", "i", "j", "fp"])
    found = [(r["a"], r["b"]) for out in simhash.nearest_forests(56, 3)(iter([batch])) for r in out.to_pylist()]
    assert len({frozenset(x) for x in found}) == len(found)
    place = {x: k for k, x in enumerate(raw)}
    bits = np.unpackbits(fps, axis=1).astype(int)
    far = (bits[:, None] != bits[None]).sum(axis=2) if len(raw) < 100 else None
    numbers = [int.from_bytes(x, "big") for x in raw]
    assert all((numbers[place[a]] ^ numbers[place[b]]).bit_count() <= 56 for a, b in found)
    near = [(a, b) for a in range(len(raw)) for b in range(a) if (numbers[a] ^ numbers[b]).bit_count() <= 56]
    assert components(len(raw), near) == components(len(raw), [(place[a], place[b]) for a, b in found])
    if far is None:
        return
    # Three minimum spanning forests, each of the pairs that those before left.
    left, total = sorted((int(far[a, b]), a, b) for a, b in near), 0
    for _ in range(3):
        root, rest = list(range(len(raw))), []
        for d, a, b in left:
            if root[a] == root[b]:
                rest.append((d, a, b))
            else:
                root = [root[a] if x == root[b] else x for x in root]
                total += 1
        left = rest
    # Ties may be broken otherwise, which moves later forests by a pair at most here and there.
    assert abs(total - len(found)) <= max(2, total // 50)


def test_sampled_tables():
    """The planned rate of overlooked pairs, against drawn pairs."""
    rng, bits, differ, missed = np.random.default_rng(3), 8, 0.15, 0.02
    tables = simhash.sampled_tables(bits, 256, differ, missed)
    masks = np.stack([rng.permutation(256)[:bits] for _ in range(tables)])
    flips = rng.random((20_000, 256)) < differ
    apart = np.mean([not (~f[masks]).all(axis=1).any() for f in flips])
    assert 0.5 * missed < apart < 1.5 * missed
    assert simhash.sampled_tables(bits, 256, differ, missed / 10) > tables


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.repeat(base, 6, axis=0) + rng.standard_normal((240, 16)) * rng.choice([0, 0.1, 0.3], 240)[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd + odd)] + [(2000, [1.0, 2.0], 0), (2001, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links int")
    out = rows_of(vectors.near_vectors(df, missed=1e-6, bucket=8), "vec_id")
    assert len(out) == len(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    roots = components(len(u), np.argwhere(near))
    for i in range(len(u)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (near[i].sum() - 1, roots[i], roots[i] == i)
    assert all((out[1000 + k]["n_links"], out[1000 + k]["kept"]) == (0, True) for k in range(12))
    assert (out[2001]["n_links"], out[2001]["component_id"]) == (1, 2000)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(1)
    good, bad = [f"word{k}" for k in range(200)], ["vileness", "vilest", "wretch"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rng.choice(good) for _ in range(50)) + (" " + rng.choice(bad) if toxic else ""), "x"))
        labels.append((i, None if i == 3 else int(i % 7 > 0), int(toxic), "y"))
    df = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    chain = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), toxicity.CATEGORIES)
    out = toxicity.scored(df, chain).collect()
    assert all((r["p_toxic"] > 0.5) == (r["doc_id"] % 5 == 0) for r in out)
    assert chain.models[1].numbers and len(chain.models) == 2
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.CATEGORIES)
    assert {r["p_toxic"] for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), chain).columns == [*[c for c in docs.columns if c != "p_toxic"], "p_low_quality", "p_toxic"]


def test_packing(docs, plain):
    ids_of = lambda x: Tokenizer.from_file(PATH).encode(x, add_special_tokens=False).ids
    out = packing.pack(docs.repartition(2), PATH)
    check_packing(out.withColumn("ids_crc32", F.crc32("ids")).collect(), plain, ids_of)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    again = packing.pack(docs.where("doc_id = 5").union(docs.where("doc_id = 5")).coalesce(1), PATH).collect()
    assert sum(r["length"] for r in again) == 2 * again[0]["doc_tokens"]


def test_packing_index_recall():
    """The index's neighbours against BM25 computed pair by pair."""
    rng = np.random.default_rng(5)
    docs = [(rng.zipf(1.3, rng.integers(5, 400)) % 500).astype(np.uint32) for _ in range(120)]
    index, n = packing.Index(docs), len(docs)
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in set(d.tolist()) for d in docs) for t in range(500)}
    found = 0
    for q in range(0, n, 10):
        scores = []
        for d in docs:
            tf = np.bincount(d, minlength=500)
            scores.append(sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[q].tolist())))
        scores[q] = -1
        unused = np.ones(n, dtype=bool)
        unused[q] = False
        found += len(set(np.argsort(scores)[-packing.NEIGHBOURS :]) & set(index.nearest(q, unused).tolist()))
    assert found / (packing.NEIGHBOURS * n / 10) >= 0.98


def test_packing_retrieves():
    """Neighbours come from the seed's own topic while there are any."""
    rng = np.random.default_rng(3)
    docs = [rng.integers(1000 * (k % 4), 1000 * (k % 4) + 60, 200).astype(np.uint32) for k in range(80)]
    sequences = {}
    for k, _, _, sequence, _ in packing.packed_shard(docs, 1024):
        sequences.setdefault(sequence, set()).add(k % 4)
    assert np.mean([len(x) == 1 for x in sequences.values()]) > 0.7


def test_packing_asks_again():
    """A window of more short documents than the index returns at once stays with the seed's topic."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(1000 * (k % 4), 1000 * (k % 4) + 60, 20 + k % 3).astype(np.uint32) for k in range(400)]
    topics, lengths = {}, {}
    for k, _, length, sequence, _ in packing.packed_shard(docs, 1024):
        topics.setdefault(sequence, set()).add(k % 4)
        lengths[sequence] = lengths.get(sequence, 0) + length
    assert sum(lengths.values()) == sum(len(d) for d in docs)
    full = [s for s, n in lengths.items() if n == 1024]
    assert len(full) == 8 and sum(len(topics[s]) == 1 for s in full) >= 4


def test_pii(docs, plain):
    out = rows_of(pii.span_digests(docs), "doc_id")
    assert check_pii(out, plain) > 5
    assert pii.span_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "masked"), [("IBAN DE89370400440532013000.", "IBAN <IBAN>."), ("acct GB82 WEST 1234 5698 7654 32", "acct <IBAN>"), ("DE89370400440532013001", "DE89370400440532013001"), ("ssn 078-05-1120", "ssn <SSN>"), ("no. 078-05-1120", "no. 078-05-1120"), ("4111111111111111 x@y.zz", "<CARD> <EMAIL>"), ("a 7536784127813050 4111111111111111 b", "a <CARD> <CARD> b"), ("a 7536784127813051 4111111111111111 b", "a 7536784127813051 <CARD> b"), ("1.2.3.204 4111111111111111", "<IP> <CARD>"), ("+1 (826) 555-4081 190.137.223.204 du", "<PHONE> <IP> du"), ("4111 1111-1111 1111", "<CARD>"), (None, None), ("", "")])
def test_redacted(spark, text, masked):
    df = spark.createDataFrame([(1, text, "k")], "doc_id long, text string, pii string")
    assert [tuple(r) for r in pii.redacted(df).collect()] == [(1, masked, "k")]


def test_pii_random(spark):
    rng = random.Random(8)
    alphabet = ["1", "23", "4111111111111111", "a", "b.c", "@", ".", "-", " ", "+", "(", ")", "_", "%", "é", "🙂", "255", "300"]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    check_pii(rows_of(pii.span_digests(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id"), texts)


def test_line_dedup(docs, plain):
    out = rows_of(linededup.without_repeats(docs), "doc_id")
    assert out[0]["text"] is None and out[0]["n_lines"] == 0
    out[0] |= {"text": "", "n_lines": 1}
    check_line_dedup(out, plain)
    assert set(linededup.without_repeats(docs).columns) == {*docs.columns, "n_removed"}
    assert linededup.without_repeats(docs.limit(0)).count() == 0


def test_line_dedup_runs(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(999)) for _ in range(rng.choice([1, 6, 12, 20, 60]))) for _ in range(300)]
    texts = []
    for i in range(120):
        own = [rng.choice(lines) if rng.random() < 0.1 else f"unique {i} {k} " + "w " * rng.randrange(15) for k in range(rng.randint(1, 12))]
        if rng.random() < 0.6:
            at = rng.randrange(len(lines) - 12)
            own[1:1] = lines[at : at + rng.randint(3, 12)]
        texts.append((i, "\n".join(own)))
    out = rows_of(linededup.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id")
    assert check_line_dedup(out, texts) > 50
    # Repeated rows are one place; a repeat inside a document goes.
    p = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, p), (1, p), (2, f"a\n{p}\nb\n{p}"), (None, p)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.without_repeats(df).collect()) == [(0, p), (1, p), (1, p), (2, "a\nb")]


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 60 + "</p>"
    pages = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "u", big), (1, "v", "short"), (2, "w", "short"), (4, "x", None), (6, "y", ""), (7, "z", "WARC/1.1\r\n\r\n" * 30), (8, "q", LONG)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, payload_bytes int").repartition(3)
    check_warc(rows_of(warc.archived(df), "page_id"), [(i, h) for i, _, h in pages])
    path = str(tmp_path / "archive")
    warc.write_warc(df, path)
    back = warc.read_warc(spark, path)
    assert {r["record_id"]: r["payload"].decode() for r in back.where("record_type = 'response'").collect()} == {f"<urn:page:{i}>": h or "" for i, _, h in pages if i not in (5, 9)}
    assert back.where("record_type = 'revisit'").select("payload").distinct().collect()[0][0] is None
    plan = back.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" not in plan.split("BatchScan")[0] or "Filter" not in plan.split("BatchScan")[0]
    assert warc.read_warc(spark, path, "record_type string, target_uri string").where("target_uri = 'u'").count() == 1
    assert warc.archived(df.limit(0)).count() == 0


def test_sharding(spark, docs, plain):
    rng = random.Random(7)
    texts = [(i, f"text {i} " * rng.randint(1, 9)) for i in range(3000)]
    texts += [(5000 + i, "a group of copies that is as large as half a shard" * 4) for i in range(15)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_sharding(rows_of(sharding.sharded(df), "doc_id"), texts, 1.02)
    # A group larger than a shard is dealt over several.
    hot = [(i, "copy " * 10 if i % 3 == 0 else f"t{i} " * 10) for i in range(9000)]
    out = sharding.sharded(spark.createDataFrame(hot, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(out) == 16 and max(r["b"] for r in out) < 1.1 * sum(r["b"] for r in out) / 16
    out = rows_of(sharding.sharded(docs), "doc_id")
    assert len(out) == len(plain) and out[0]["size"] == 1 and out[0]["text_crc32"] == 0
    assert sharding.sharded(docs.limit(0)).count() == 0
    full = sharding.sharded(df, shards=None, capacity=20_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r["b"] for r in full) <= 20_000 and len(full) <= 1.05 * sum(r["b"] for r in full) / 20_000 + 1


@pytest.mark.parametrize("n", range(5))
def test_best_fit(n):
    rng = random.Random(n)
    sizes = {k: rng.randint(1, 60) for k in range(200)}
    bins, capacity = [], 100
    for size in sorted(sizes.values(), reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= size]
        if fits:
            bins[min(fits, key=lambda k: (bins[k], k))] -= size
        else:
            bins.append(capacity - size)
    placed = sharding.best_fit(sizes, capacity)
    left = [capacity - sum(sizes[i] for i, b in placed.items() if b == k) for k in range(max(placed.values()) + 1)]
    assert sorted(left) == sorted(bins)


def test_rows_without_ids(spark):
    """Rows without an id come back, as often as they are there."""
    rows = [(None, "no id here"), (None, "no id here"), (None, None), (7, "an id"), (7, "an id"), (8, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (
        fingerprints.edited_fingerprints(df), fingerprints.fingerprints(df), bpe.encoded(df, PATH), simhash.simhash_groups(df), simhash.similar_groups(df),
        pii.span_digests(df), linededup.without_repeats(df), sharding.sharded(df), packing.pack(df, PATH).where("start = 0"),
    ):
        got = [r["doc_id"] for r in out.collect()]
        assert got.count(None) == 3 and got.count(7) == 2 and got.count(8) == 1
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert sorted(str(r["page_id"]) for r in warc.archived(pages).collect()) == ["7", "7", "8", "None", "None", "None"]
    vecs = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in vectors.near_vectors(vecs).collect()) == [("1", 1, True), ("1", 1, True), ("None", 0, True)]
    kept = corpus_pipeline.without_near_duplicates(spark, df, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "8", "None", "None", "None"]


def test_pipeline_stages(spark, docs, tmp_path):
    """Every stage takes any table with ids and texts, empty ones too, and all but the last keep its columns."""
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0), docs.union(docs)):
            out = stage(spark, df, sf)
            assert name == "packing" or (out.columns == df.columns and out.dtypes == df.dtypes), name
            out.count()


def test_pipeline(spark):
    """Stage by stage against brute force."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = cut(corpus_pipeline.without_toxic(spark, docs, sf))
    left = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in left) == (not t) for i, t in labels.items()]) > 0.95
    lines = corpus_pipeline.without_repeated_lines(spark, kept, sf)
    direct = rows_of(linededup.without_repeats(kept), "doc_id")
    after = rows_of(lines, "doc_id")
    assert after.keys() == {i for i, r in direct.items() if not r["n_removed"] or r["text"].strip()}
    assert all(r["text"] == direct[i]["text"] and r["n_chars"] == len(r["text"]) for i, r in after.items())
    near = rows_of(corpus_pipeline.without_near_duplicates(spark, lines, sf), "doc_id")
    groups = {}
    for r in simhash.similar_groups(lines).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert near.keys() == {min(g) for g in groups.values()} == groups.keys()
    texts = [(i, r["text"]) for i, r in sorted(near.items())]
    masked = rows_of(corpus_pipeline.without_personal_data(spark, spark.createDataFrame([tuple(r.values()) for r in near.values()], lines.schema), sf), "doc_id")
    for i, text in texts:
        hidden = re.search(r"<(EMAIL|IP|CARD|PHONE|IBAN|SSN)>", masked[i]["text"]) is not None
        assert hidden or masked[i]["text"] == text
    assert xxhash.xxh64_intdigest(b"") and corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
