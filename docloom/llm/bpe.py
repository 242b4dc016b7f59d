"""Byte-level byte-pair encoding and decoding.

A piece's symbols form a doubly linked list; a heap holds the candidate merges
by (rank, position).  The best one is taken, skipped if one of its symbols has
changed since, and replaced by the pairs that its result forms with its
neighbours: O(n log n) for a piece of n bytes, so that a text without any
white space costs no more than another.  Decoding concatenates the vocabulary's
byte strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_arrow, small_batches, strings

# The pattern that cuts a text into pieces, as the vocabulary's makers published it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same over ASCII, where the standard library's engine is several times as fast.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+"
# These four count as white space for the standard library alone.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Pieces whose ids a process remembers; beyond it they are worked out anew.
REMEMBERED = 400_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary, to the byte.

    Printable bytes of Latin-1 stand for themselves; the others take the
    characters from 256 on, in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class BytePairs:
    """A byte-level tokenizer read from a ``tokenizer.json`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_symbols()
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.first = [vocab[bytes([b])] for b in range(256)]
        #: Two ids to the rank of their merge and the id that it gives.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * self.size
        for t, i in vocab.items():
            self.strings[i] = t
        for t, i in self.special.items():
            self.strings[i] = t.encode()
        self.cut = regex.compile(PIECES).findall
        self.cut_ascii = re.compile(ASCII_PIECES).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece, merged in the order of ranks and, among equals, from the left."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merge = self.merge
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for k in range(n - 1):
            if found := merge.get((ids[k], ids[k + 1])):
                heap.append((found[0], k, found[1], ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, made, left, right = heapq.heappop(heap)
            m = after[k]
            if ids[k] != left or m < 0 or ids[m] != right:
                continue  # stale: a symbol has merged meanwhile
            ids[k], ids[m] = made, -1
            after[k] = after[m]
            if after[m] >= 0:
                before[after[m]] = k
                if found := merge.get((made, ids[after[m]])):
                    heapq.heappush(heap, (found[0], k, found[1], made, ids[after[m]]))
            if before[k] >= 0 and (found := merge.get((ids[before[k]], made))):
                heapq.heappush(heap, (found[0], before[k], found[1], ids[before[k]], made))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> list[str]:
        return (self.cut_ascii if text.isascii() and not SEPARATORS.search(text) else self.cut)(text)

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; strings of special tokens in it become their ids."""
        out: list[int] = []
        known, get = self.known, self.known.get
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pieces(part):
                ids = get(piece)
                if ids is None:
                    ids = self.piece_ids(piece.encode())
                    if len(piece) <= LONGEST_REMEMBERED:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[piece] = ids
                out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Vocabulary strings of ``ids``, special tokens included, as UTF-8; broken bytes become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> BytePairs:
    """The tokenizer of a file, read once for each process."""
    return BytePairs(path)


def encoded(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, decoded) of every document, without a shuffle.

    A null text counts as empty and has no ids.  Repeated rows stay repeated,
    other columns are not read, and an empty table gives no rows.
    """
    rows = small_arrow(docs).selectExpr(f"`{doc_id}` as doc_id", f"cast(`{text}` as string) as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in small_batches(batches):
            ids = [t.encode(x) for x in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document.

    As :func:`encoded`, but ids and decoded texts stay in the task that made
    them.
    """
    rows = small_arrow(docs).selectExpr(f"`{doc_id}` as doc_id", f"cast(`{text}` as string) as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        decimal = [str(i) for i in range(t.size)]
        for batch in small_batches(batches):
            counts, of_ids, of_text = [], [], []
            for x in strings(batch.column("text")):
                ids = t.encode(x)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
