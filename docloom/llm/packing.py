"""Packing documents into training sequences by lexical retrieval.

The documents of a scan form shards of bounded size, each with its own BM25
inverted index over token ids.  A seed document opens a window; the index
returns its nearest unused neighbours, which fill the window greedily: those
that fit whole in the order of their scores, and at last the nearest one, cut
at the window's end.  What is left of it opens the next window.  Full windows
of a long document stand alone.  A shard's last window is cut at powers of two,
which need no padding.  Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PIECES, tokenizer
from .common import small_arrow, small_batches, strings

#: Limits of a shard; a document beyond them is a shard by itself.
SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
#: BM25's parameters, and neighbours returned.
K1, B, NEIGHBOURS = 1.2, 0.75, 16
#: Characters of a text that the compiled encoder gets at once, and where texts may be cut.
SEGMENT, CUT = 65_536, re.compile(r"\S(?=[ \n])")


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """From a text to its ids, for the vocabulary of a ``tokenizer.json`` file.

    The compiled encoder ranks merges by id; a vocabulary whose ids are in
    another order goes through :class:`~docloom.llm.bpe.BytePairs`.
    """
    t = tokenizer(path)
    made = [i for _, i in sorted(t.merge.values())]
    if made != sorted(set(made)) or made and min(made) <= max(t.first):
        return lambda text: np.array(t.encode(text), dtype=np.uint32)
    special = set(t.special.values())
    ranks = {s: i for i, s in enumerate(t.strings) if s and i not in special}
    fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=t.special)

    def encode(text: str) -> np.ndarray:
        if len(text) <= SEGMENT:
            return fast.encode_to_numpy(text, allowed_special="all")
        return np.concatenate([fast.encode_to_numpy(x, allowed_special="all") if len(x) <= 2 * SEGMENT else np.array(t.encode(x), dtype=np.uint32) for x in segments(text)])

    return encode


def segments(text: str) -> Iterator[str]:
    """``text`` in parts of about ``SEGMENT`` characters, cut where no piece of the tokenizer goes on.

    A blank or line break after something else always begins a piece, and
    nothing before it looks beyond it.  A part is longer only where a run has
    no such place; the compiled encoder, whose patterns need a stack as deep
    as a run of white space is long, doesn't get it.
    """
    at = 0
    while len(text) - at > SEGMENT and (found := CUT.search(text, at + SEGMENT)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class Index:
    """BM25 over the token ids of one shard."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = self.n = len(docs)
        lengths = np.array([len(d) for d in docs])
        parts = [np.unique(d, return_counts=True) for d in docs]
        terms = np.concatenate([p[0] for p in parts])
        tf = np.concatenate([p[1] for p in parts]).astype(np.float32)
        owner = np.repeat(np.arange(n), [len(p[0]) for p in parts])
        _, slot, df = np.unique(terms, return_inverse=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1)).astype(np.float32)
        weight = idf[slot] * tf * (K1 + 1) / (tf + norm[owner])
        by_term = np.argsort(slot, kind="stable")
        self.owner, self.weight = owner[by_term], weight[by_term]
        self.at = np.concatenate([[0], np.cumsum(df)])
        # A document's query: all its terms that others share.
        shared = df[slot] > 1
        self.slots, firsts = slot[shared], np.searchsorted(owner[shared], np.arange(n + 1))
        self.queries = list(zip(firsts[:-1].tolist(), firsts[1:].tolist()))

    def nearest(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents by falling score; ties by position."""
        first, end = self.queries[doc]
        terms = self.slots[first:end]
        starts, counts = self.at[terms], self.at[terms + 1] - self.at[terms]
        # The positions of all the terms' postings.
        places = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(terms) else starts
        scores = np.bincount(self.owner[places], self.weight[places], self.n)
        scores[~unused] = 0
        best = np.argpartition(-scores, min(NEIGHBOURS, self.n - 1))[:NEIGHBOURS] if self.n > NEIGHBOURS else np.arange(self.n)
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))]


def packed_shard(docs: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard."""
    sizes = np.array([len(d) for d in docs])
    sequence = 0
    rest = sizes % window  # what has no full window of its own comes first in its document
    for k in np.flatnonzero(sizes >= window):
        for start in range(int(rest[k]), int(sizes[k]), window):
            yield int(k), start, window, sequence, 0
            sequence += 1
    index = Index(docs)
    unused = rest > 0
    in_order = iter(np.argsort(-rest, kind="stable"))
    done = np.zeros(len(docs), dtype=np.int64)
    room, last, carried = window, [], -1
    while carried >= 0 or unused.any():
        seed = carried if carried >= 0 else next(int(k) for k in in_order if unused[k])
        unused[seed], carried = False, -1
        near = [int(k) for k in index.nearest(seed, unused)]
        more = len(near) == NEIGHBOURS
        chosen = seed
        while chosen >= 0:
            take = min(room, int(rest[chosen] - done[chosen]))
            last.append((chosen, int(done[chosen]), take, window - room))
            done[chosen] += take
            room -= take
            unused[chosen] = False
            if not room:
                for k, start, length, offset in last:
                    yield k, start, length, sequence, offset
                sequence, room, last = sequence + 1, window, []
                carried = chosen if done[chosen] < rest[chosen] else -1
                break
            near = [k for k in near if unused[k]]
            if not near and more:
                near = [int(k) for k in index.nearest(seed, unused)]
                more = len(near) == NEIGHBOURS
            fits = [k for k in near if rest[k] <= room]
            chosen = fits[0] if fits else near[0] if near else -1
    # The last window, cut at powers of two.
    filled, left = 0, window - room
    while filled < left:
        size = 1 << ((left - filled).bit_length() - 1)
        for k, start, length, offset in last:
            lo, hi = max(offset, filled), min(offset + length, filled + size)
            if lo < hi:
                yield k, start + lo - offset, hi - lo, sequence, lo - filled
        filled, sequence = filled + size, sequence + 1


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents, packed into sequences of ``window`` ids at most.

    Returns (doc_id, start, length, ids binary, doc_tokens, sequence_id,
    offset): ``ids`` are little-endian 32-bit numbers, ``start`` counts the
    document's ids before the piece, ``offset`` those before it in its
    sequence.  Each document is followed by ``end_id``; so an empty or null
    text has one id.  Every id lies in one piece, and every sequence is full or
    as long as a power of two.  Sequences are numbered by partition and shard.
    Repeated rows are packed each; an empty table gives no rows.  A text of any
    length is encoded whole, also one that is a single run of one character.
    """
    rows = small_arrow(docs).selectExpr(f"`{doc_id}` as doc_id", f"cast(`{text}` as string) as text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def flush(ids: list, tokens: list[np.ndarray], base: int) -> Iterator[pa.RecordBatch]:
        pieces = list(packed_shard(tokens, window))
        for k in range(0, len(pieces), 1000):
            d, start, length, sequence, offset = zip(*pieces[k : k + 1000])
            columns = [pa.array([ids[x] for x in d], arrow_kind[0]), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            columns += [pa.array([tokens[x][s : s + n].astype("<u4").tobytes() for x, s, n in zip(d, start, length)], pa.binary())]
            columns += [pa.array([len(tokens[x]) for x in d], pa.int64()), pa.array(np.array(sequence, dtype=np.int64) + base), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    arrow_kind: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base, end = TaskContext.get().partitionId() << 40, np.array([end_id], dtype=np.uint32)
        ids, tokens, held = [], [], 0
        for batch in small_batches(batches):
            arrow_kind[0] = batch.column("doc_id").type
            for i, x in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                now = np.concatenate([encode(x), end])
                if tokens and (len(tokens) >= SHARD_DOCS or held + len(now) > SHARD_TOKENS):
                    yield from flush(ids, tokens, base)
                    base, ids, tokens, held = base + (1 << 20), [], [], 0
                ids.append(i)
                tokens.append(now)
                held += len(now)
        if tokens:
            yield from flush(ids, tokens, base)

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
