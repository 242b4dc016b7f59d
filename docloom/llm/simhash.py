"""SimHash near-duplicates, exact for every pair of fingerprints.

A text's fingerprint has 64 bits, each the majority of that bit over the
XXH64 hashes of its word shingles.  The fingerprint is embedded as the bit
counts of its 32 segments of two bits: the Manhattan distance of two
embeddings is a lower bound of the Hamming distance of the fingerprints.

Grid: the segments form 16 groups, numbered as the points of the affine space
of dimension 4 over two elements.  At most four groups differ between
embeddings at a distance of four or less; any four points lie in one of the 30
hyperplanes, so that all groups of the complementary hyperplane agree.  A
fingerprint therefore enters 30 cells, each keyed by the counts in one
hyperplane, and fingerprints within the radius share a cell.  In the cells the
Manhattan bound screens pairs and the Hamming distance decides.  Only equal
fingerprints are merged before, and no link is lost.  Counts of two bits let
about 5 in a million random pairs into a shared cell; where that makes more
than ``CANDIDATES`` to a fingerprint, segments of one bit key the cells, which
let in 7 in a billion and are complete by the same hyperplanes.

A similarity such as 0.8 lies far beyond four bits.  For it,
:func:`similar_groups` takes fingerprints of 256 bits over the distinct
shingles, of which it reads the cosine of two texts' sets, and cells keyed by
sampled bits, in as many tables as the recall wanted needs.  There the
fingerprints only propose: each cell gives a spanning forest of its near pairs,
and whether the texts of a proposed pair share enough of their shingles is
decided exactly.  Where a proposal is refused, all pairs of the texts that
proposals connect are decided, so that no pair is hidden by others.  Texts of so
few shingles that bits tell less are joined by their shingles.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import dealt_cells
from .common import Forest, cut, dealt_join, group_starts, small_arrow, small_batches, whole_groups
from .components import connected_components

SEED = 42
#: The construction covers differences in up to this many bits.
RADIUS = 4
GROUPS = 16
#: Random fingerprints that may share a cell with one before cells are keyed by shorter segments.
CANDIDATES = 128
#: Rows of a group above which it is compared in blocks.
BLOCK = 256
#: Rows of a group up to which all its near pairs are held at once.
HELD = 512
#: Rows of a chunk of sets, and bytes.
SETS, SET_BYTES = 2048, 8 << 20
#: Members of a set up to which sets are compared from the start.
FEW = 24


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``text``, repeats included; none where it has no word.

    ASCII capitals are lowered; words are what lies between ASCII white space;
    a text of fewer words has one shingle.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(tokens) - words + 1)


def majority(hashes: np.ndarray, lanes: int = 1) -> int:
    """For each bit, whether it is set in over half the hashes; 0 for no hashes.

    The first lane's 64 bits come from the hashes, those of further lanes from
    mixes of them.
    """
    counts = np.zeros(64 * lanes, dtype=np.int64)
    salts = np.arange(lanes, dtype=np.uint64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096]
        if lanes > 1:
            part = np.where(salts > 0, mixed(part[:, None], salts), part[:, None])
        bits = part.astype(">u8").view(np.uint8).reshape(-1, 8 * lanes)
        counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def simhash(text: str, words: int = 4, lanes: int = 1, distinct: bool = False) -> int:
    """The fingerprint of ``text``, of 64 bits for each lane; 0 where it has no word.

    Shingles count as often as they occur, or with ``distinct`` once.
    """
    hashes = shingle_hashes(text, words)
    return majority(np.unique(hashes) if distinct else hashes, lanes)


def simhashes(docs: DataFrame, words: int = 4, lanes: int = 1, distinct: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every document; null texts count as empty.

    With one lane ``fp`` is a bigint with the fingerprint's bits, with more it
    is binary.
    """
    rows = small_arrow(docs).selectExpr(f"`{doc_id}` as doc_id", f"cast(`{text}` as string) as text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [simhash(x or "", words, lanes, distinct) for x in batch.column("text").to_pylist()]
            column = pa.array(np.array(fps, dtype=np.uint64).view(np.int64)) if lanes == 1 else pa.array([x.to_bytes(8 * lanes, "big") for x in fps], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp {'bigint' if lanes == 1 else 'binary'}")


def lanes_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints as rows of 64-bit lanes."""
    if column.type == pa.int64():
        return column.to_numpy().view(np.uint64)[:, None]
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64).reshape(len(raw), -1)


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, each in two bits of a number."""
    low = np.uint64(0x5555555555555555)
    return fps - ((fps >> np.uint64(1)) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings as :func:`segment_counts` packs them.

    With 0, 1 and 2 written in unary (00, 01, 11), the distance of two counts
    is the number of differing bits.
    """
    return np.bitwise_count(unary(a) ^ unary(b))


def unary(counts: np.ndarray) -> np.ndarray:
    low = np.uint64(0x5555555555555555)
    two = (counts >> np.uint64(1)) & low
    return (two << np.uint64(1)) | two | (counts & low)


def hyperplanes() -> np.ndarray:
    """For each of the 30 hyperplanes, a mask of the bits of its groups of segments."""
    masks = []
    width = 64 // GROUPS
    for normal in range(1, GROUPS):
        for side in (0, 1):
            mask = 0
            for point in range(GROUPS):
                if (normal & point).bit_count() % 2 == side:
                    mask |= ((1 << width) - 1) << (width * point)
            masks.append(mask)
    return np.array(masks, dtype=np.uint64)


def mixed(keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits, with ``salt`` added first."""
    with np.errstate(over="ignore"):
        x = keys + salt * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_cells(batches: Iterator[pa.RecordBatch], segment: int = 2) -> Iterator[pa.RecordBatch]:
    """The 30 cells of each fingerprint of one lane, keyed by the bit counts of segments of ``segment`` bits, 2 or 1."""
    masks = hyperplanes()
    salts = np.arange(1, len(masks) + 1, dtype=np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
            counts = segment_counts(fps) if segment == 2 else fps
            keys = mixed(counts[:, None] & masks[None, :], salts[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, len(masks)).view(np.int64))], ["cell", "fp"])


def segment_for(n: int) -> int:
    """Bits of a segment for ``n`` fingerprints: two counts agree with probability 3/8, and a cell has 16 of them."""
    return 2 if n * len(hyperplanes()) * (3 / 8) ** 16 <= CANDIDATES else 1


def sampled_tables(bits: int, size: int, differ: float, missed: float) -> int:
    """Tables of cells keyed by ``bits`` of ``size`` bits in which a pair shares no cell with probability ``missed`` at most.

    Each bit of the pair differs with probability ``differ``: so the number of
    those that do is binomial, and the pairs with many of them need the most
    tables.
    """
    n = range(size + 1)
    chance = np.array([math.comb(size, k) * differ**k * (1 - differ) ** (size - k) for k in n])
    shared = np.array([math.comb(size - k, bits) / math.comb(size, bits) for k in n])

    def enough(tables: int) -> bool:
        return float(chance @ (1 - shared) ** tables) <= missed

    high = 1
    while not enough(high):
        high *= 2
    return bisect.bisect_left(range(high), True, lo=high // 2, key=enough)


def in_sampled_cells(bits: int, tables: int, lanes: int, seed: int = 11):
    """(cell, fp, node): cells keyed by ``bits`` bits, drawn anew for each of ``tables`` tables."""
    rng = np.random.default_rng(seed)
    masks = np.zeros((tables, lanes), dtype=np.uint64)
    for t in range(tables):
        for b in rng.choice(64 * lanes, bits, replace=False).tolist():
            masks[t, b // 64] |= np.uint64(1 << (b % 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                column = whole.column("fp").slice(at, 1024)
                fps = lanes_of(column)
                keys = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (len(fps), tables))
                for lane in range(lanes):
                    keys = mixed(fps[:, lane, None] & masks[None, :, lane], keys)
                again = pa.array(np.repeat(np.arange(len(fps)), tables))
                nodes = whole.column("node").slice(at, 1024)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), column.take(again), nodes.take(again)], ["cell", "fp", "node"])

    return run


def linked_forest(radius: int):
    """For rows sorted into groups, pairs that join what lies within the radius.

    Of the links inside a batch only a spanning forest leaves the task: at
    most one pair a row.
    """

    def within(fps: np.ndarray, coded: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = manhattan(coded[a], coded[b]).sum(axis=1, dtype=np.int64) <= radius
        a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64) <= radius
        return a[near], b[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cell", "i", "j"]):
            column = rows.column("fp").combine_chunks()
            fps = lanes_of(column)
            _, first, where = np.unique(fps.view(f"V{8 * fps.shape[1]}").ravel() if fps.shape[1] > 1 else fps[:, 0], return_index=True, return_inverse=True)
            forest = Forest(len(first))
            coded = segment_counts(fps)
            starts = group_starts(rows, ["cell", "i", "j"])
            ends = np.append(starts[1:], len(fps))
            small = ends - starts <= BLOCK
            end_of = np.repeat(np.where(small, ends, 0), ends - starts)
            at = np.flatnonzero(end_of > np.arange(len(fps)) + 1)
            step = 1
            while len(at):
                a, b = within(fps, coded, at, at + step)
                forest.add(where[a], where[b])
                step += 1
                at = at[at + step < end_of[at]]
            for start, end in zip(starts[~small], ends[~small]):
                for k in range(start, end - 1):
                    # What the row's tree has already needs no comparison.
                    others = np.arange(k + 1, end)
                    others = others[forest.label[where[others]] != forest.label[where[k]]]
                    a, b = within(fps, coded, np.full(len(others), k), others)
                    forest.add(where[a], where[b])
            inner = np.flatnonzero(forest.label != np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([column.take(pa.array(first[forest.label[inner]])), column.take(pa.array(first[inner]))], ["a", "b"])

    return run


def hooked(label: Forest, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins trees by some of the pairs and says by which; all pairs end up in one tree each."""
    chosen = []
    left = np.arange(len(a))
    while True:
        x, y = label.label[a[left]], label.label[b[left]]
        differ = x != y
        if not differ.any():
            return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)
        left, x, y = left[differ], x[differ], y[differ]
        # Each tree hooks onto one with a smaller label: no cycle arises.
        _, first = np.unique(np.maximum(x, y), return_index=True)
        chosen.append(left[first])
        label.add(a[left[first]], b[left[first]])


def nearest_forests(radius: int, forests: int = 1, name: str = "fp"):
    """For rows sorted into groups, pairs of each group within the radius: a minimum spanning forest, then one of the pairs left, and so on.

    Pairs are given by the rows' values of column ``name``.
    """

    def distances(fps: np.ndarray, a, b) -> np.ndarray:
        return np.bitwise_count(fps[a] ^ fps[b]).sum(axis=-1, dtype=np.int64)

    def spanning(fps: np.ndarray, start: int, end: int, taken: dict[int, list[int]]) -> list[tuple[int, int]]:
        """Prim's algorithm over one large group, without the pairs ``taken``: as much memory as it has rows."""
        rest, place, pairs = np.arange(start + 1, end), np.arange(-1, end - start - 1), []
        best, near, new = np.full(len(rest), radius + 1), np.full(len(rest), start), start
        while len(rest):
            now = distances(fps, rest, new)
            for old in taken.get(new, ()):
                at = place[old - start]
                if at >= 0:
                    now[at] = radius + 1
            closer = now < best
            best[closer], near[closer] = now[closer], new
            k = int(best.argmin())
            new = int(rest[k])
            if best[k] <= radius:
                pairs.append((int(near[k]), new))
            # The last row takes the place of the one that leaves.
            place[rest[-1] - start], place[new - start] = k, -1
            for x in (rest, best, near):
                x[k] = x[-1]
            rest, best, near = rest[:-1], best[:-1], near[:-1]
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cell", "i", "j"]):
            column = rows.column("fp").combine_chunks()
            fps = lanes_of(column)
            coded = unary(segment_counts(fps))
            starts = group_starts(rows, ["cell", "i", "j"])
            ends = np.append(starts[1:], len(fps))
            small = ends - starts <= HELD
            end_of = np.repeat(np.where(small, ends, 0), ends - starts)
            at = np.flatnonzero(end_of > np.arange(len(fps)) + 1).astype(np.int32)
            pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            step = 1
            while len(at):
                bound = np.bitwise_count(coded[at] ^ coded[at + step]).sum(axis=1, dtype=np.int64)
                a = at[bound <= radius]
                d = distances(fps, a, a + step)
                pairs.append((a[d <= radius], a[d <= radius] + np.int32(step), d[d <= radius].astype(np.int16)))
                step += 1
                at = at[at + step < end_of[at]]
            a, b, d = (np.concatenate(x) if pairs else np.zeros(0, dtype=np.int64) for x in (list(zip(*pairs)) or [[], [], []]))
            left, right = [], []
            for _ in range(forests):
                # Kruskal's algorithm, one distance at a time.
                trees, free = Forest(len(fps)), np.ones(len(a), dtype=bool)
                for level in np.unique(d):
                    same = np.flatnonzero(d == level)
                    free[same[hooked(trees, a[same], b[same])]] = False
                left += a[~free].tolist()
                right += b[~free].tolist()
                a, b, d = a[free], b[free], d[free]
            for start, end in zip(starts[~small].tolist(), ends[~small].tolist()):
                taken: dict[int, list[int]] = {}
                for _ in range(forests):
                    for x, y in spanning(fps, start, end, taken):
                        left.append(x)
                        right.append(y)
                        taken.setdefault(x, []).append(y)
                        taken.setdefault(y, []).append(x)
            kinds, named = pa.int64(), rows.column(name).combine_chunks()
            yield pa.RecordBatch.from_arrays([named.take(pa.array(left, kinds)), named.take(pa.array(right, kinds))], ["a", "b"])

    return run


def shingle_sets(words: int, lanes: int):
    """(node, shingles) of the texts whose fingerprint is the one beside them, as rows of one id may hold different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            nodes, sets = [], []
            for text, fp, node in zip(*(batch.column(c).to_pylist() for c in ("text", "fp", "node"))):
                found = np.unique(shingle_hashes(text or "", words))
                if majority(found, lanes).to_bytes(8 * lanes, "big") == fp:
                    nodes.append(node)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def confirmed(similarity: float):
    """Pairs and whether their sets share at least ``similarity`` of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096, "s"):
            yes = []
            for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                yes.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(yes, pa.bool_())], ["a", "b", "yes"])

    return run


def prefix(sizes, similarity: float):
    """So many of a set's first members, in any one order, hold one of every set that is similar enough."""
    return sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1


def set_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets that connect whatever the pairs similar enough connect; with ``side``, pairs of two sides.

    Pairs already connected are not compared, nor are those whose rarest
    members have none in common; every other pair is decided exactly.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, slot, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    slot = slot[np.lexsort((slot, df[slot], owner))]
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(slot)) - starts[owner]
    kept = np.flatnonzero((inside < prefix(sizes, similarity)[owner]) & (df[slot] > 1))
    kept = kept[np.argsort(slot[kept], kind="stable")]
    posted, post_owner = slot[kept], owner[kept]
    began = np.searchsorted(posted, posted)
    # Of each row, where the postings of its first members begin, and its own among them.
    by_row = np.argsort(post_owner, kind="stable")
    row_at = np.searchsorted(post_owner[by_row], np.arange(len(sets) + 1))
    label, mark, links = np.arange(len(sets)), np.zeros(len(df), dtype=bool), []

    def runs(lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.repeat(lows - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())

    for k in range(len(sets)):
        mine = by_row[row_at[k] : row_at[k + 1]]
        counts = mine - began[mine]
        if not counts.any():
            continue
        common = np.bincount(post_owner[runs(began[mine], counts)], minlength=k)
        others = np.flatnonzero(common)
        others = others[(label[others] != label[k]) & (np.minimum(sizes[others], sizes[k]) >= similarity * np.maximum(sizes[others], sizes[k]))]
        if side is not None:
            others = others[side[others] != side[k]]
        others = others[np.argsort(-common[others], kind="stable")]
        own = slot[starts[k] : starts[k] + sizes[k]]
        mark[own] = True
        # One row of each tree first, as it may spare the others.
        ahead = np.sort(np.unique(label[others], return_index=True)[1])
        for tried in (others[ahead], np.delete(others, ahead)):
            tried = tried[label[tried] != label[k]]
            if not len(tried):
                continue
            shared = np.add.reduceat(mark[slot[runs(starts[tried], sizes[tried])]], np.cumsum(sizes[tried]) - sizes[tried], dtype=np.int64)
            for other in tried[shared >= similarity * (sizes[tried] + sizes[k] - shared)].tolist():
                if label[other] != label[k]:
                    links.append((other, k))
                    label[label == label[other]] = label[k]
        mark[own] = False
    return links


def linked_sets(similarity: float):
    """For sets sorted into groups, the pairs of :func:`set_links` of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cell", "i", "j"]):
            column, shingles = rows.column("node").combine_chunks(), rows.column("shingles")
            i, j, side = (rows.column(c).to_numpy() for c in ("i", "j", "side"))
            starts = group_starts(rows, ["cell", "i", "j"])
            left, right = [], []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in shingles.slice(start, end - start).to_pylist()]
                for x, y in set_links(sets, None if i[start] == j[start] else side[start:end], similarity):
                    left.append(start + x)
                    right.append(start + y)
            kinds = pa.int64()
            yield pa.RecordBatch.from_arrays([column.take(pa.array(left, kinds)), column.take(pa.array(right, kinds))], ["a", "b"])

    return run


def differing(x: int, y: int, shared: int) -> float:
    """The probability that a bit of the fingerprints of two sets differs, for sets of ``x`` and ``y`` members of which they share some."""
    of = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    both, a, b = np.arange(shared + 1)[:, None], np.arange(x - shared + 1), np.arange(y - shared + 1)
    one, other = (2 * (both + a) > x) @ of(x - shared), (2 * (both + b) > y) @ of(y - shared)
    return float(of(shared) @ (one * (1 - other) + other * (1 - one)))


@lru_cache(maxsize=8)
def most_differing(similarity: float, above: int = FEW) -> float:
    """The largest probability that a bit of a similar enough pair differs, where a set has more than ``above`` members.

    It falls with the size of the sets towards what their cosine tells.
    """
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for y in range(above + 1, 3 * above):
        for x in range(math.ceil(similarity * y - 1e-9), y + 1):
            least = math.ceil(similarity * (x + y) / (1 + similarity) - 1e-9)
            most = max([most, *(differing(x, y, k) for k in range(least, x + 1))])
    return most


def small_sets(words: int, lanes: int, similarity: float, most: int = FEW):
    """(fp, shingles, cells) of texts of at most ``most`` shingles: a cell for each of the set's first members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            cells, fps, sets = [], [], []
            for text in batch.column("text").to_pylist():
                # Texts of many words may have few shingles, as these may repeat.
                found = np.unique(shingle_hashes(text or "", words)) if few_enough(text or "", words, most) else ()
                if 0 < len(found) <= most:
                    cells.append(found[: int(prefix(np.int64(len(found)), similarity))].view(np.int64).tolist())
                    fps.append(majority(found, lanes).to_bytes(8 * lanes, "big"))
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["fp", "shingles", "cells"])

    return run


def few_enough(text: str, words: int, most: int) -> bool:
    """Whether a text may have ``most`` distinct shingles or fewer, by its distinct words: a shingle holds ``words`` at most."""
    return len(set(text.encode().lower().split())) <= most + words - 1


def linked(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints whose graph has the components of all links within four bits.

    ``fps`` has distinct fingerprints of one lane in its column fp.
    """
    segment = segment_for(fps.count())
    cells = fps.select("fp").mapInArrow(lambda batches: in_cells(batches, segment), "cell bigint, fp bigint")
    return dealt_cells(cells, "cell", "fp").mapInArrow(linked_forest(RADIUS), "a bigint, b bigint")


def grouped(marked: DataFrame, pairs_of, numbered: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp) and a function from distinct fingerprints (fp, first, node) to linked pairs of nodes.

    ``node`` is the fingerprint itself or, with ``numbered``, a number for it,
    which joins move and compare more cheaply than long fingerprints.
    """
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # The checkpoint fixes the numbers.
    least = cut(least.withColumn("node", F.monotonically_increasing_id() if numbered else F.col("fp")))
    roots = connected_components(pairs_of(least))
    placed = cut(least.join(roots, "node", "left").select("fp", "first", "n", F.coalesce("root", "node").alias("root")))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = cut(placed.join(firsts, "root").select("fp", "component_id"))
    return dealt_join(marked, of_fp, placed.select("fp", "n"), ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, words: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Documents whose fingerprints differ in four bits or fewer are linked;
    ``component_id`` is the smallest id reachable by links.  Documents without
    a word have fingerprint 0 and are linked like others.  A null id is never
    the smallest unless its component has no other.  Repeated rows stay
    repeated; an empty table gives no rows; other columns are not read.
    """
    return grouped(cut(simhashes(docs, words, text=text, doc_id=doc_id)), linked)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, missed: float = 1e-3, bucket: int = 128, lanes: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every document, by the part of their shingles that texts share.

    Documents are linked where their sets of shingles have a Jaccard
    similarity of ``similarity`` or more, and where their fingerprints are
    equal.  Fingerprints count each shingle once: then such texts have a cosine
    of 2 s / (1 + s) at least, by which the bits of their fingerprints differ
    (somewhat more often where sets are small, which is counted out).  The
    radius leaves out a pair at the threshold with probability ``missed`` at
    most, and so do the tables.  Each
    cell proposes a spanning forest.  Where a proposal's texts share too
    little, all pairs among the texts that proposals connect are decided by
    their sets.  Texts of at most ``FEW`` shingles, whose bits differ still more
    often, are compared by their sets from the start.  The number of
    bits of a cell follows the number of fingerprints, so that cells keep
    their size.  Nulls, ids and repeated rows as in :func:`simhash_groups`.
    """
    differ, size = most_differing(similarity), 64 * lanes
    chance = np.array([math.comb(size, k) * differ**k * (1 - differ) ** (size - k) for k in range(size + 1)])
    radius = int(np.argmax(1 - np.cumsum(chance) <= missed))

    def by_sets(rows: DataFrame) -> DataFrame:
        groups = dealt_cells(rows, "cell", "node", SETS, F.octet_length("shingles"), SET_BYTES)
        return groups.mapInArrow(linked_sets(similarity), "a bigint, b bigint")

    def pairs_of(least: DataFrame) -> DataFrame:
        n = least.count()
        bits = max(6, math.ceil(math.log2(max(n, 1) / bucket)))
        tables = sampled_tables(bits, 64 * lanes, differ, missed)
        cells = least.select("fp", "node").mapInArrow(in_sampled_cells(bits, tables, lanes), "cell bigint, fp binary, node bigint")
        proposed = dealt_cells(cells, "cell", "node").mapInArrow(nearest_forests(radius, name="node"), "a bigint, b bigint")
        proposed = cut(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        # One document stands for each fingerprint that has a proposal.
        ends = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(least, "node")
        texts = docs.select(F.col(doc_id).alias("first"), F.col(text).cast("string").alias("text")).join(ends, "first")
        sets = cut(texts.select("text", "fp", "node").mapInArrow(shingle_sets(words, lanes), "node bigint, shingles binary").dropDuplicates(["node"]))
        both = proposed.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
        decided = cut(both.select("a", "b", "s", "t").mapInArrow(confirmed(similarity), "a bigint, b bigint, yes boolean"))
        # Of what proposals connect, that with a refused pair and some pair not yet decided.
        roots = cut(connected_components(decided))
        counts = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        refused = decided.join(roots, F.col("a") == F.col("node")).groupBy("root").agg(F.bool_or(~F.col("yes")).alias("no"), F.count(F.lit(1)).alias("n_pairs"))
        mixed_roots = refused.join(counts, "root").where("no and 2 * n_pairs < n * (n - 1)").select("root")
        mixed_rows = roots.join(mixed_roots, "root").join(sets, "node")
        hidden = by_sets(mixed_rows.select(F.col("root").alias("cell"), "node", "shingles"))
        bodies = docs.select(F.col(text).cast("string").alias("text"))
        small = bodies.mapInArrow(small_sets(words, lanes, similarity), "fp binary, shingles binary, cells array<bigint>").dropDuplicates(["fp", "shingles"])
        small = by_sets(small.join(least, "fp").select(F.explode("cells").alias("cell"), "node", "shingles"))
        return decided.where("yes").select("a", "b").unionByName(cut(hidden)).unionByName(cut(small))

    return grouped(cut(simhashes(docs, words, lanes, True, text, doc_id)), pairs_of, numbered=True)
