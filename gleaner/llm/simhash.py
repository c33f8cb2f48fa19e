"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits; two link at ``limit`` or fewer differing bits. It is
cut into a ring of ``segments``. If two fingerprints link, then from some segment
on every chain of l segments holds at most l * limit / segments differences. So
each distinct fingerprint is filed, for every start, under its first ``depth``
segments, and asks there under all that the chains allow these to be. Where
they meet, the next chains are checked before the full distance is.

``CONTRACT`` links at 4 bits: 5 segments, filed under two, of which the first
must be equal and the second differs in at most one bit. ``COPIES`` finds
candidates only: 13 bits, filed under the first of 7 segments, and a second
fingerprint from other bits of hashes has to come close too, at most 32 of both
together. Each of the two is filed in turn, so a pair is lost only if both miss.

Fingerprints don't decide which documents ``one_of_each`` removes. Texts that
candidates join are compared by their sets of shingles, and link at a Jaccard
similarity of 4/5 or more, computed exactly. Large sets of candidates are compared
block by block of about ``BLOCK`` texts. Links still chain: a removed document is
that similar to one of its component, not always to the one that stays.

Only distinct fingerprints are compared, so copies cost nothing. Where many meet
under one key and most of them link, each reaches its links by a search that
visits it once; links come out as trees, never as all pairs of a group.
Components are joined from these by rounds of minima over stored tables.

The comparisons under a key grow with the square of the distinct fingerprints
over the number of keys: 2^26 for ``CONTRACT``, 2^9, twice, for ``COPIES``.

Null and empty texts, and texts without a word, have the fingerprint zero, linked
like any other. Rows with equal or null ids count as rows; a component of rows
that all have null ids has a null id. ``one_of_each`` takes texts without a word as
copies of each other. An empty table gives an empty result;
further columns are ignored, or kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.common import prefixed, restored, stored

SHINGLE = 4
SEED = 42
BITS = 64
ENTRIES_PER_BUCKET = 400_000
TEXTS = 512
FILED_AT_ONCE = 4_096
PAIRS_AT_ONCE = 2_000_000
SMALL_GROUP = 16_384
SIMILAR = (4, 5)  # least Jaccard similarity of copies, as a fraction
BLOCK = 128
SET_BYTES_PER_BUCKET = 8 << 20
COLUMNS_AT_ONCE = 8_192
DENSE = 64  # links per filed fingerprint from which a group is searched


@dataclass(frozen=True)
class Scheme:
    limit: int
    segments: int
    depth: int
    confirm: int | None = None  # most differing bits of both fingerprints

    def begin(self, i: int) -> int:
        return round(i % self.segments * BITS / self.segments)

    def width(self, i: int) -> int:
        i %= self.segments
        return round((i + 1) * BITS / self.segments) - self.begin(i)

    def budget(self, length: int) -> int:
        """Most differences in a chain of that many segments."""
        return length * self.limit // self.segments

    def masks(self, start: int) -> np.ndarray:
        """What the first ``depth`` segments may differ in, as keys."""

        def extend(j: int, used: int) -> Iterator[int]:
            if j == self.depth:
                yield 0
                return
            slot = 16 * (self.depth - 1 - j)
            for n in range(min(self.width(start + j), self.budget(j + 1) - used) + 1):
                for bits in combinations(range(self.width(start + j)), n):
                    for rest in extend(j + 1, used + n):
                        yield sum(1 << (slot + b) for b in bits) | rest

        return np.array(sorted(extend(0, 0)), dtype=np.uint64)

    def entries(self) -> int:
        """Rows filed and asked for one fingerprint."""
        return sum(len(self.masks(s)) for s in range(self.segments))


CONTRACT = Scheme(limit=4, segments=5, depth=2)
COPIES = Scheme(limit=13, segments=7, depth=1, confirm=32)


def hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of all shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - shingle + 1)
    end = (begin + size)[-n:]
    digest = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin[:n].tolist(), end.tolist(), strict=True)]
    return np.array(digest, dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    bytes_ = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(bytes_[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, into: str = "fp",
                 confirm: str | None = None, of_set: str | None = None) -> DataFrame:
    """``docs`` with ``into``, the fingerprint as a signed 64-bit number, and, if
    named, a second one from the hashes mixed once more. Both are then of the
    distinct shingles: a line or word that fills two otherwise different texts
    doesn't make them copies. ``of_set``, only with the second, is a hash of the
    distinct shingles."""
    from xxhash import xxh64_intdigest

    names = [into, *([confirm] if confirm else []), *([of_set] if of_set else [])]
    schema = StructType(list(docs.schema))
    for name in names:
        schema = schema.add(name, "long")

    def both(text: str | None) -> list[int]:
        h = hashes(text, shingle)
        if confirm:
            h = np.unique(h)
        found = [fingerprint(h)]
        whole = [xxh64_intdigest(h.tobytes(), SEED)] if of_set else []
        if confirm:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            found.append(fingerprint(h ^ (h >> np.uint64(29))))
        return found + whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at_text = whole.schema.get_field_index(text)
            for at in range(0, whole.num_rows, TEXTS):
                part = whole.slice(at, TEXTS)
                fps = np.array([both(t) for t in part.column(at_text).to_pylist()], dtype=np.uint64).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(fps[:, i])) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _segment(scheme: Scheme, fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(scheme.begin(i))) & np.uint64((1 << scheme.width(i)) - 1)


def chain_keys(scheme: Scheme, fp: np.ndarray, start: int) -> np.ndarray:
    """The first ``depth`` segments from ``start`` as one number, with the start."""
    key = np.full(len(fp), start, dtype=np.uint64) << np.uint64(40)
    for j in range(scheme.depth):
        key |= _segment(scheme, fp, start + j) << np.uint64(16 * (scheme.depth - 1 - j))
    return key


def linked(scheme: Scheme, a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether fingerprints link: the chains from ``start`` first, the full distance
    for those that pass, then the second fingerprints."""
    diff = a ^ b
    within = np.zeros(len(diff), dtype=bool)
    for first in np.unique(start):
        own = np.flatnonzero(start == first)
        sums = np.zeros(len(own), dtype=np.int64)
        for length in range(1, scheme.segments):
            sums += np.bitwise_count(_segment(scheme, diff[own], int(first) + length - 1))
            keep = sums <= scheme.budget(length)
            own, sums = own[keep], sums[keep]
        within[own] = True
    at = np.flatnonzero(within)
    within[at] = _close(scheme, diff[at], a2[at] ^ b2[at])
    return within


def _close(scheme: Scheme, diff: np.ndarray, diff2: np.ndarray) -> np.ndarray:
    count = np.bitwise_count(diff)
    if scheme.confirm is None:
        return count <= scheme.limit
    return (count <= scheme.limit) & (count.astype(np.int64) + np.bitwise_count(diff2) <= scheme.confirm)


def _search(scheme: Scheme, fps: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group as trees: each fingerprint is visited once, and compared
    with those not visited yet. Places in ``fps``."""
    left = np.arange(len(fps))
    parents, children = [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            step = max(1, PAIRS_AT_ONCE // len(left))
            block, frontier = frontier[:step], frontier[step:]
            near = _close(scheme, fps[block][:, None] ^ fps[left][None, :], second[block][:, None] ^ second[left][None, :])
            hit = near.any(axis=0)
            parents.append(block[near[:, hit].argmax(axis=0)])
            children.append(left[hit])
            frontier = np.concatenate([frontier, left[hit]])
            left = left[~hit]
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *children])


def _large_group(scheme: Scheme, start: int, at: np.ndarray, own: np.ndarray, fps: np.ndarray,
                 second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large group, row block by row block: the chain one segment
    longer than the key for all pairs, the rest for those that pass."""
    filed = at[own[at]]
    chain = np.uint64(0)
    for j in range(scheme.depth + 1):
        chain |= np.uint64((1 << scheme.width(start + j)) - 1) << np.uint64(scheme.begin(start + j))
    budget = scheme.budget(scheme.depth + 1)
    all_ = fps[at] & chain
    lefts, rights, hits = [], [], 0
    step = max(1, PAIRS_AT_ONCE // len(at))
    for row in range(0, len(filed), step):
        block = filed[row : row + step]
        r, c = np.nonzero(np.bitwise_count((fps[block] & chain)[:, None] ^ all_[None, :]) <= budget)
        a, b = block[r], at[c]
        differ = fps[a] != fps[b]
        a, b = a[differ], b[differ]
        hit = linked(scheme, fps[a], fps[b], second[a], second[b], np.full(len(a), start))
        lefts.append(a[hit]), rights.append(b[hit])
        hits += int(hit.sum())
        if hits > DENSE * (row + len(block)):
            _, one = np.unique(fps[at], return_index=True)
            nodes = at[one]
            a, b = _search(scheme, fps[nodes], second[nodes])
            return nodes[a], nodes[b]
    return np.concatenate(lefts), np.concatenate(rights)


def meet(scheme: Scheme, fps: np.ndarray, second: np.ndarray, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one bucket of filed and asking fingerprints."""
    order = np.argsort(keys, kind="stable")
    fps, second, keys, own = fps[order], second[order], keys[order], own[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    end = np.append(begin[1:], len(keys))
    n_own = np.add.reduceat(own.astype(np.int64), begin)
    several = np.flatnonzero((n_own > 0) & (end - begin > 1))
    pairs = n_own * (end - begin)
    none = np.empty(0, dtype=np.uint64)
    lefts, rights = [none], [none]
    for g in several[pairs[several] > SMALL_GROUP]:
        start = int(keys[begin[g]] >> np.uint64(40))
        a, b = _large_group(scheme, start, np.arange(begin[g], end[g]), own, fps, second)
        lefts.append(fps[a]), rights.append(fps[b])
    # Small groups: every filed one with every other, many groups at a time.
    small = several[pairs[several] <= SMALL_GROUP]
    while len(small):
        cut = max(1, int(np.searchsorted(np.cumsum(pairs[small]), PAIRS_AT_ONCE)))
        part, small = small[:cut], small[cut:]
        size = end[part] - begin[part]
        group = np.repeat(part, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[group]
        filed, of = at[own[at]], group[own[at]]
        width = end[of] - begin[of]
        left = np.repeat(filed, width)
        right = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin[of], width)
        differ = fps[left] != fps[right]
        left, right = left[differ], right[differ]
        start = (keys[left] >> np.uint64(40)).astype(np.int64)
        hit = linked(scheme, fps[left], fps[right], second[left], second[right], start)
        lefts.append(fps[left[hit]]), rights.append(fps[right[hit]])
    return np.concatenate(lefts), np.concatenate(rights)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links as join the same values."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    kept = [np.empty(0, dtype=np.int64)]
    open_ = np.arange(len(a))
    while True:
        x, y = label[left[open_]], label[right[open_]]
        open_, x, y = open_[x != y], x[x != y], y[x != y]
        if not len(open_):
            break
        # Every tree takes one link to a tree of smaller label, so no cycle closes.
        high, pick = np.unique(np.maximum(x, y), return_index=True)
        parent = np.arange(len(nodes))
        parent[high] = np.minimum(x, y)[pick]
        kept.append(open_[pick])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    own = np.concatenate(kept)
    return a[own], b[own]


def links(distinct: DataFrame, scheme: Scheme, buckets: int) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` (confirmed by ``fp2``)
    that join all that link, ``a < b`` as signed numbers."""
    confirmed = scheme.confirm is not None

    def packed(fp: np.ndarray, fp2: np.ndarray) -> pa.RecordBatch:
        keys, rows, own = [], [], []
        for start in range(scheme.segments):
            masks = scheme.masks(start)
            keys.append((chain_keys(scheme, fp, start)[None, :] ^ masks[:, None]).ravel())
            rows.append(np.tile(np.arange(len(fp)), len(masks)))
            own.append(np.repeat(masks == 0, len(fp)))
        key, row, own = np.concatenate(keys), np.concatenate(rows), np.concatenate(own)
        spread = key * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((spread >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, row, own, bucket = key[order], row[order], own[order], bucket[order]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
        ends = [*at[1:], len(bucket)] if at else []
        cuts = [slice(a, b) for a, b in zip(at, ends, strict=True)]
        out = {
            "bucket": pa.array(bucket[at], pa.int64()),
            "fps": pa.array([fp[row[c]].tobytes() for c in cuts], pa.binary()),
            "second": pa.array([fp2[row[c]].tobytes() if confirmed else b"" for c in cuts], pa.binary()),
            "keys": pa.array([key[c].tobytes() for c in cuts], pa.binary()),
            "own": pa.array([own[c].tobytes() for c in cuts], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(out)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, fp2 = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            for at in range(0, len(fp), FILED_AT_ONCE):
                yield packed(fp[at : at + FILED_AT_ONCE], fp2[at : at + FILED_AT_ONCE])

    def gather(table: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)

        fps = joined("fps", np.uint64)
        second = joined("second", np.uint64) if confirmed else fps
        a, b = forest(*meet(scheme, fps, second, joined("keys", np.uint64), joined("own", bool)))
        both = np.unique(np.sort(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    filed = distinct.select("fp", "fp2").mapInArrow(file, "bucket long, fps binary, second binary, keys binary, own binary")
    return filed.groupBy("bucket").applyInArrow(gather, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``, ``root`` the smallest node
    reachable. Large and small stars in turn until nothing moves; a node's
    neighbours are only ever reduced to a minimum and joined back."""
    edges = stored(edges.filter("a <> b"), "links")
    while True:
        # Every larger neighbour of a node links to the smallest node around it.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "links")
        # Every smaller neighbour of a node, and the node, link to the smallest.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            large.join(small, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        moved = stored(moved, "links")
        edges = moved
        # Done when every node has one smaller neighbour, which has none itself.
        several = moved.groupBy("a").count().filter("count > 1").select("a")
        chained = moved.join(moved.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if several.union(chained).isEmpty():
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def grouped(prints: DataFrame, least: Column, scheme: Scheme) -> DataFrame:
    """``fp, least`` for every fingerprint of ``prints(fp, fp2, ...)``: the smallest
    value of ``least`` in its component."""
    distinct = stored(prints.groupBy("fp").agg(F.min("fp2").alias("fp2"), F.min(least).alias("own")), "fingerprints")
    buckets = max(1, math.ceil(distinct.count() * scheme.entries() / ENTRIES_PER_BUCKET))
    roots = components(links(distinct, scheme, buckets)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("own").alias("least"))
    return rooted.join(of_root, "root").select("fp", "least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    scheme: Scheme = CONTRACT) -> DataFrame:
    """``key, fingerprint, component_id`` of every document."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    prints = fingerprints(rows, "text", shingle, "fp", "fp2" if scheme.confirm else None).drop("text")
    prints = stored(prints if scheme.confirm else prints.withColumn("fp2", F.col("fp")), "fingerprints")
    return prints.join(grouped(prints, F.col("key"), scheme), "fp").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of distinct values with a Jaccard similarity of ``SIMILAR`` or more."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    of = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column, of = (np.cumsum(shared) - 1)[column[shared[column]]], of[shared[column]]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for at in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
        has = np.zeros((len(sets), min(COLUMNS_AT_ONCE, int(column[b - 1]) - at + 1)), dtype=np.float32)
        has[of[a:b], column[a:b] - at] = 1
        both += (has @ has.T).astype(np.int64)
    either = size[:, None] + size[None, :] - both
    return np.nonzero(np.triu(both * SIMILAR[1] >= either * SIMILAR[0], 1))


def candidates(distinct: DataFrame, scheme: Scheme) -> DataFrame:
    """``node, root`` of the texts ``distinct(id, fp, fp2)`` that either fingerprint
    joins to others. Equal fingerprints join as well."""
    buckets = max(1, math.ceil(distinct.count() * scheme.entries() / ENTRIES_PER_BUCKET))
    edges = None
    for one, other in (("fp", "fp2"), ("fp2", "fp")):
        prints = distinct.select(F.col(one).alias("fp"), F.col(other).alias("fp2")).distinct()
        first = stored(distinct.groupBy(F.col(one).alias("fp")).agg(F.min("id").alias("first")), "first")
        a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"of_{x}")) for x in "ab")
        near = links(prints, scheme, buckets).join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        equal = distinct.join(first, distinct[one] == first["fp"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
        edges = near.union(equal) if edges is None else edges.union(near).union(equal)
    return components(edges)


def copies(texts: DataFrame, roots: DataFrame, shingle: int, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between the texts ``texts(id, text)`` of one root of
    ``roots(node, root)`` that join all whose shingles are similar enough."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    member = roots.join(sizes, "root").select(F.col("node").alias("id"), "root", blocks.alias("blocks"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                part = whole.slice(at, TEXTS)
                found = [np.unique(hashes(t, shingle)).tobytes() for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.binary())], ["id", "root", "blocks", "hashes"])

    joined = texts.join(member, "id").select("id", "root", "blocks", "text")
    own = stored(joined.mapInArrow(sets, "id long, root long, blocks int, hashes binary"), "shingles")
    total = own.agg(F.sum((F.length("hashes") + 64).cast("long") * F.col("blocks"))).first()[0] or 0
    buckets = max(1, math.ceil(total / SET_BYTES_PER_BUCKET))
    # Every block meets every other of its root, and itself, in one row group each.
    at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = own.withColumn("at", at).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = placed.select("id", "root", F.least("at", "with").alias("low"), F.greatest("at", "with").alias("high"), "hashes")
    spread = pair.withColumn("bucket", F.pmod(F.xxhash64("root", "low", "high"), F.lit(buckets)))

    def compare(table: pa.Table) -> pa.Table:
        id_, root, low, high = (table.column(c).to_numpy() for c in ("id", "root", "low", "high"))
        order = np.lexsort((id_, high, low, root))
        held = table.column("hashes").to_pylist()
        key = np.stack([root, low, high])[:, order]
        begin = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        none = np.empty(0, dtype=np.int64)
        lefts, rights = [none], [none]
        for group in np.split(order, begin[1:]):
            if len(group) > 1:
                a, b = similar([np.frombuffer(held[i], dtype=np.uint64) for i in group])
                lefts.append(id_[group[a]]), rights.append(id_[group[b]])
        a, b = forest(np.concatenate(lefts), np.concatenate(rights))
        return pa.table({"a": a, "b": b})

    return spread.groupBy("bucket").applyInArrow(compare, "a long, b long")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                scheme: Scheme = COPIES) -> DataFrame:
    """``docs`` without the near-duplicates: of every component the row with the
    smallest key stays, null keys last; of equal keys one row."""
    base = prefixed(docs).withColumn("row", F.monotonically_increasing_id())
    base = stored(fingerprints(base, f"d_{text}", shingle, "fp", "fp2", "id"), "fingerprinted")
    least = F.struct(F.col(f"d_{key}").isNull().alias("none"), F.col(f"d_{key}").alias("key"), F.col("row").alias("row"))
    distinct = base.groupBy("id").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min(least).alias("own"))
    distinct = stored(distinct, "fingerprints")
    roots = stored(candidates(distinct, scheme), "candidates")
    shown = distinct.join(roots, distinct["id"] == roots["node"], "left_semi").select(F.col("own.row").alias("row"))
    texts = base.join(shown, "row", "left_semi").select("id", F.col(f"d_{text}").alias("text"))
    linked_ = components(copies(texts, roots, shingle)).withColumnRenamed("node", "id")
    rooted = distinct.join(linked_, "id", "left").withColumn("root", F.coalesce("root", "id"))
    kept = rooted.groupBy("root").agg(F.min("own").alias("least")).select(F.col("least.row").alias("row"))
    return restored(base.join(kept, "row", "left_semi"), docs.columns)
