"""The queries of docloom.llm against brute force over whole small tables."""

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from docloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def rows_of(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def components(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return sorted(zip(t["doc_id"].to_pylist(), (x or "" for x in t["text"].to_pylist())))


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t, lambda x: t.encode(x, add_special_tokens=False).ids


def canonical(text):
    folded = unicodedata.normalize("NFKC", text).casefold()
    return re.sub(r"\s+", " ", folded).strip(" ")


def test_op1(spark, documents):
    out = rows_of(QUERIES["op1_fingerprints"](spark, SF), "doc_id")
    assert len(out) == len(documents)
    by_text = defaultdict(set)
    for k, (i, text) in enumerate(documents):
        following = documents[(k + 1) % len(documents)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        got = out[i]
        assert got["n_chars"] == len(text)
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got["near_edited"] == float(canonical(text) == canonical(edited))
        assert got["near_next"] == float(canonical(text) == canonical(following))
        by_text[canonical(text)].add((got["fingerprint"], got["group_id"], got["group_size"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert len({x for v in by_text.values() for x in v}) == len(by_text)


def test_op2(spark, documents, encode):
    t, ids_of = encode
    out = rows_of(QUERIES["op2_bpe"](spark, SF), "doc_id")
    for i, text in documents:
        ids = ids_of(text)
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def fingerprint(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3(spark, documents):
    out = rows_of(QUERIES["op3_simhash"](spark, SF), "doc_id")
    fps = [fingerprint(x) for _, x in documents]
    array = np.array(fps, dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4)]
    roots = components(len(fps), pairs)
    for (i, _), fp, root in zip(documents, fps, roots):
        assert out[i]["fingerprint"] == f"{fp:016x}"
        assert out[i]["component_id"] == documents[root][0]


def test_op4(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    x = np.array(t["embedding"].to_pylist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = t["vec_id"].to_pylist()
    out = rows_of(QUERIES["op4_embeddings"](spark, SF), "vec_id")
    roots = components(len(ids), np.argwhere(near))
    for k, i in enumerate(ids):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (near[k].sum() - 1, ids[roots[k]], roots[k] == k)


def test_op5(spark):
    out = rows_of(QUERIES["op5_toxicity"](spark, SF), "doc_id")
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    assert len(out) == 1000
    assert np.mean([out[r["doc_id"]]["toxic"] == bool(r["toxic"]) for r in labels]) > 0.95


def test_op6(spark, documents, encode):
    out = QUERIES["op6_packing"](spark, SF).collect()
    check_packing(out, documents, encode[1])


def check_packing(out, documents, ids_of):
    ids = {i: [*ids_of(x), 0] for i, x in documents}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def check_pii(out, documents):
    found = 0
    for i, text in documents:
        base = base_spans(text)
        found += len(base)
        listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in base)
        assert out[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (i, listed, out[i]["spans"])
        assert [out[i][f"n_{k}"] for k in PATTERNS] == [sum(b[3] == k for b in base) for k in PATTERNS]
        assert set(listed.split(",")) - {""} <= set(out[i]["spans"].split(","))
    return found


def test_op7(spark, documents):
    assert check_pii(rows_of(QUERIES["op7_pii"](spark, SF), "doc_id"), documents) > 50


def test_op8(spark, documents):
    out = rows_of(QUERIES["op8_line_dedup"](spark, SF), "doc_id")
    check_line_dedup(out, documents)


def check_line_dedup(out, documents, words=50):
    """Deleted runs are in an earlier place; no passage of 50 words stays twice unless its gram came first elsewhere."""
    squeezed = {i: [" ".join(x.split()) for x in text.split("\n")] for i, text in documents}
    places = defaultdict(list)
    for i, _ in documents:
        for k, line in enumerate(squeezed[i]):
            places[line].append((i, k))
    removed = 0
    for i, text in documents:
        lines, gone = text.split("\n"), set()
        for run in filter(None, out[i]["removed"].split(",")):
            lo, hi = map(int, run.split(":"))
            gone |= set(range(lo, hi))
            assert sum(len(x.split()) for x in lines[lo:hi]) >= words
            assert any(all(k < len(squeezed[j]) and squeezed[j][k] == squeezed[i][lo + n] for n, k in enumerate(range(at, at + hi - lo))) for j, at in places[squeezed[i][lo]] if (j, at) < (i, lo))
        assert out[i]["n_removed"] == len(gone) and out[i]["n_lines"] == len(lines)
        if gone:
            assert out[i]["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        else:
            assert out[i]["text"] == text
        removed += len(gone)
    # Of each window of lines with 50 words, all places but the first have lost a line.
    first_at = {}
    for i, _ in documents:
        lines = squeezed[i]
        lost = {k for run in filter(None, out[i]["removed"].split(",")) for k in range(*map(int, run.split(":")))}
        for lo in range(len(lines)):
            hi, held = lo, 0
            while hi < len(lines) and held < words:
                held += len(lines[hi].split())
                hi += 1
            if held >= words:
                assert first_at.setdefault(tuple(lines[lo:hi]), (i, lo)) == (i, lo) or lost & set(range(lo, hi))
    # Every line of 50 words and more stays once.
    seen, left = set(), 0
    for i, _ in documents:
        for line in out[i]["text"].split("\n"):
            line = " ".join(line.split())
            if len(line.split()) >= words:
                left += line in seen
                seen.add(line)
    assert left == 0
    assert {x for v in squeezed.values() for x in v} == {" ".join(x.split()) for i, _ in documents for x in out[i]["text"].split("\n")} | {""} or removed
    return removed


def test_op9(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    out = rows_of(QUERIES["op9_warc"](spark, SF), "page_id")
    check_warc(out, [(p["page_id"], p["html"]) for p in pages])


def check_warc(out, pages):
    firsts = {}
    for i, html in sorted(pages):
        raw = (html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        first = firsts.setdefault(digest, i) if len(raw) >= 100 else i
        assert (out[i]["payload_bytes"], out[i]["payload_digest"]) == (len(raw), digest)
        assert (out[i]["record_type"], out[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))


def test_op10(spark, documents):
    out = rows_of(QUERIES["op10_sharding"](spark, SF), "doc_id")
    check_sharding(out, documents, 1.01)


def check_sharding(out, documents, level):
    loads, slots, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    for i, text in documents:
        r = out[i]
        raw = text.encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[text].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in texts.values())
    assert set(loads) == set(range(16)) and max(loads.values()) <= level * sum(loads.values()) / 16


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*names).collect())
