"""Benchmark decontamination by suffix arrays over the training text.

Every some thousand documents are a shard. Their words become numbers of the
benchmark's vocabulary (0: a word no item has), a suffix array orders the suffixes
that can begin a match by their first words, and every distinct window of the items
(each suffix of an item begins one) is found in it by binary search, with all its places.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but
not none, is one window. Windows that follow each other wherever they stand in the
benchmark form a strand, and all of a strand have the same items. So a place is
never paired with every item that has its window: it belongs to one strand, the
items of a document are those of its strands, and a match is told by the first item
that holds it. Matches are read from left to right: each is the longest verbatim
match with any one item from its place on, the next begins with the first window
that it lacks. Together they cover every word that is hit.

Shards need nothing from each other, so the documents are read once and nothing is
shuffled. Of the benchmark, blocks whose index takes about ``BLOCK_BYTES`` are
indexed once and broadcast one after another, a scan for each.

Null and empty texts have no words, no hits and are clean. A null item id
counts as an empty string; items that share an id are one. Repeated rows give
repeated results, an empty table or benchmark gives no hits; further columns
pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from gleaner.llm.common import WORD_BYTES, own_column, prefixed, restored

WINDOW = 10
BLOCK_BYTES = 48 << 20
INDEX_BYTES = 12  # of the index for a character of an item, about
SHARD_BYTES = 4 << 20
SHARD_ITEMS = 200_000  # item ids in a batch of results
MATCHES = ArrayType(StructType().add("item", "string").add("doc_word", "integer").add("item_word", "integer")
                    .add("n_words", "integer"))
_PA_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()),
                                  ("n_words", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


@dataclass
class Windows:
    """The distinct windows of one length in the order of their words, and the
    strands that they form. Items lie behind each other, their words are numbered
    through with a gap after each."""

    length: int
    keys: np.ndarray
    head: np.ndarray  # first word
    strand: np.ndarray
    step: np.ndarray  # place in its strand
    place_at: np.ndarray  # where strand s begins in the items: places[place_at[s] : place_at[s + 1]]
    places: np.ndarray
    item_at: np.ndarray  # items of strand s: items[item_at[s] : item_at[s + 1]]
    items: np.ndarray
    first: np.ndarray  # by word: whether a window begins or ends with it
    last: np.ndarray


def _keys(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The words from each place as one comparable value."""
    if not len(at):
        return np.empty(0, dtype=f"S{4 * length}")
    rows = ids[at[:, None] + np.arange(length)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * length}").ravel()


def _strands(window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strand and step of every window; ``window`` stands at ``place``, ascending."""
    count = np.bincount(window)
    follows = np.flatnonzero(place[1:] == place[:-1] + 1)
    pair, times = np.unique(window[follows] * len(count) + window[follows + 1], return_counts=True)
    one, two = np.divmod(pair, len(count))
    always = (times == count[one]) & (times == count[two])
    before = np.full(len(count), -1)
    before[two[always]] = one[always]
    _, at = np.unique(window, return_index=True)  # first occurrences: consecutive within a strand
    order = np.argsort(at)
    head = before[order] < 0
    strand, step = np.empty(len(count), dtype=np.int64), np.empty(len(count), dtype=np.int64)
    strand[order] = np.cumsum(head) - 1
    step[order] = np.arange(len(count)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    return strand, step


def index_items(items: list[tuple[str, str | None]], window: int) -> tuple[dict[bytes, int], list[str], np.ndarray, np.ndarray, list[Windows]]:
    """Vocabulary (from 1), item ids, where each text begins and whose it is, and the
    windows by length."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    begin, owner, at = [], [], 0
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for name, text in items:
        words = words_of(text)
        if not words:
            continue
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], dtype=np.uint32)
        by_length.setdefault(min(window, len(ids)), []).append((ids, at))
        begin.append(at)
        owner.append(names.setdefault(name, len(names)))
        at += len(ids) + 1
    begin, owner = np.array(begin, dtype=np.int64), np.array(owner, dtype=np.int64)
    out = []
    for length, rows in sorted(by_length.items()):
        keys = np.concatenate([_keys(ids, np.arange(len(ids) - length + 1), length) for ids, _ in rows])
        place = np.concatenate([start + np.arange(len(ids) - length + 1) for ids, start in rows])
        distinct, which = np.unique(keys, return_inverse=True)
        words = np.ascontiguousarray(distinct).view(">u4").reshape(len(distinct), length)
        first = np.zeros(len(vocabulary) + 1, dtype=bool)
        last = first.copy()
        first[words[:, 0]] = True
        last[words[:, -1]] = True
        strand, step = _strands(which, place)
        top = np.flatnonzero(step[which] == 0)
        top = top[np.argsort(strand[which[top]], kind="stable")]
        own = strand[which[top]]
        bounds = np.arange(strand.max() + 2)
        who = owner[np.searchsorted(begin, place[top], "right") - 1]
        pairs = np.unique(own * len(names) + who)
        out.append(
            Windows(length, distinct, words[:, 0].astype(np.uint32), strand, step, np.searchsorted(own, bounds), place[top],
                    np.searchsorted(pairs // len(names), bounds), pairs % len(names), first, last)
        )
    return vocabulary, list(names), begin, owner, out


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each belongs to."""
    size = stop - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def _matches(place: np.ndarray, count: np.ndarray, strand: np.ndarray, step: np.ndarray, w: Windows) -> list[tuple[int, int, int]]:
    """``place, place in the items, windows`` of the matches of pieces of strands,
    each beginning where the one before ends."""

    def standing(i: int) -> np.ndarray:
        return w.places[w.place_at[strand[i]] : w.place_at[strand[i] + 1]] + step[i]

    out, start, alive = [], 0, standing(0)
    for i in range(1, len(place)):
        shift = place[i] - place[start]
        longer = np.intersect1d(alive, standing(i) - shift, assume_unique=True)
        if not len(longer):
            out.append((place[start], alive[0], shift))
            start, longer = i, standing(i)
        alive = longer
    out.append((place[start], alive[0], place[-1] + count[-1] - place[start]))
    return out


def shard_matches(ids: np.ndarray, begin: np.ndarray, windows: list[Windows]) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
    """``place, place in the items, length`` of the matches in a shard, and the
    items of each document.

    ``ids`` holds the word numbers of its documents, with a 0 after each;
    documents begin at ``begin``."""
    found = [np.empty((0, 3), dtype=np.int64)]
    items: list[list[np.ndarray]] = [[] for _ in begin]
    unknown = np.flatnonzero(ids == 0)
    known = unknown[np.searchsorted(unknown, np.arange(len(ids)))] - np.arange(len(ids)) if len(ids) else ids
    for w in windows:
        may = np.flatnonzero(w.first[ids] & (known >= w.length))
        may = may[w.last[ids[may + w.length - 1]]]
        if not len(may):
            continue
        keys = _keys(ids, may, w.length)
        order = np.argsort(keys, kind="stable")  # the suffix array
        keys, may = keys[order], may[order]
        begins = np.zeros(len(w.first), dtype=bool)
        begins[ids[may]] = True
        sought = np.flatnonzero(begins[w.head])
        lo, hi = np.searchsorted(keys, w.keys[sought], "left"), np.searchsorted(keys, w.keys[sought], "right")
        at, of = _expand(lo, hi)
        if not len(at):
            continue
        place, hit = may[at], sought[of]
        order = np.argsort(place)
        place, strand, step = place[order], w.strand[hit[order]], w.step[hit[order]]
        # Places that follow each other in a strand are one piece.
        follows = place[1:] == place[:-1] + 1
        head = np.flatnonzero(np.append(True, ~follows | (strand[1:] != strand[:-1]) | (step[1:] != step[:-1] + 1)))
        count = np.diff(np.append(head, len(place)))
        doc = np.searchsorted(begin, place[head], "right") - 1
        of_doc = np.unique(doc * len(w.place_at) + strand[head])
        docs, own = np.divmod(of_doc, len(w.place_at))
        edge = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        for a, b in zip(edge, [*edge[1:], len(docs)], strict=True):
            sets = [w.items[w.item_at[x] : w.item_at[x + 1]] for x in own[a:b]]
            items[docs[a]].append(np.unique(np.concatenate(sets)))
        place, strand, step = place[head], strand[head], step[head]
        chain = np.flatnonzero(np.append(True, place[1:] != place[:-1] + count[:-1]))
        size = np.diff(np.append(chain, len(place)))
        single = chain[size == 1]
        found.append(np.stack([place[single], w.places[w.place_at[strand[single]]] + step[single], count[single] + w.length - 1], 1))
        for a, n in zip(chain[size > 1], size[size > 1], strict=True):
            part = slice(a, a + n)
            rows = np.array(_matches(place[part], count[part], strand[part], step[part], w), dtype=np.int64)
            found.append(rows + [0, 0, w.length - 1])
    place, item_place, length = np.concatenate(found).T
    return (place, item_place, length), [np.unique(np.concatenate(x)) if x else np.empty(0, dtype=np.int64) for x in items]


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"] or "") * INDEX_BYTES + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _shards(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SHARD_BYTES`` of text."""
    column = batch.column(batch.schema.get_field_index(text))
    size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in column], dtype=np.int64)
    shard = (np.cumsum(size) - size) // SHARD_BYTES
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    for a, b in zip(at, [*at[1:], len(shard)], strict=True):
        yield batch.slice(a, b - a)


def _scan(rows: DataFrame, text: str, words: str, matches: str, items: str, shared) -> DataFrame:
    """``rows`` with the number of words, the matches and the items of one block appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, names, item_begin, owner, packed = shared.value
        windows = [Windows(*w) for w in packed]
        lookup = vocabulary.get
        names = pa.array(names, pa.string())
        for batch in (shard for whole in batches for shard in _shards(whole, text)):
            numbers = [
                np.array([lookup(w, 0) for w in words_of(t)] + [0], dtype=np.uint32)
                for t in batch.column(batch.schema.get_field_index(text)).to_pylist()
            ]
            size = np.array([len(x) for x in numbers], dtype=np.int64)
            begin = np.cumsum(size) - size
            (place, item_place, length), items_of = shard_matches(np.concatenate(numbers), begin, windows)
            doc = np.searchsorted(begin, place, "right") - 1
            order = np.lexsort((length, place, doc))
            place, item_place, length, doc = (c[order] for c in (place, item_place, length, doc))
            text_of = np.searchsorted(item_begin, item_place, "right") - 1
            inner = pa.StructArray.from_arrays(
                [names.take(pa.array(owner[text_of])), pa.array((place - begin[doc]).astype(np.int32)),
                 pa.array((item_place - item_begin[text_of]).astype(np.int32)), pa.array(length.astype(np.int32))],
                fields=list(_PA_MATCHES.value_type),
            )
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(bounds), inner)
            n = np.array([len(x) for x in items_of])
            part = (np.cumsum(n) - n) // SHARD_ITEMS
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(at, [*at[1:], len(n)], strict=True):
                ends = np.append(0, np.cumsum(n[a:b])).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(items_of[a:b]))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array((size[a:b] - 1).astype(np.int32)), found.slice(a, b - a), own],
                    [*batch.schema.names, words, matches, items],
                )

    schema = StructType(list(rows.schema)).add(words, "integer").add(matches, MATCHES).add(items, ArrayType(StringType()))
    return rows.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``matches``: verbatim matches of at least a window,
    as ``(item, doc_word, item_word, n_words)``, and ``items``: all that have an
    occurring window. Blocks of the benchmark are matched apart."""
    ids = F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item")
    rows = benchmark.select(ids, F.col(item_text).alias("text")).orderBy("item", "text")
    out, count, parts, named = docs, None, [], []
    # An empty benchmark still counts the words.
    for block in [*_blocks(rows, block_bytes)] or [[]]:
        words, matches, items = (own_column(out, n) for n in ("n_words_", "matches_", "items_"))
        *index, windows = index_items(block, window)
        shared = docs.sparkSession.sparkContext.broadcast((*index, [astuple(w) for w in windows]))
        scanned = _scan(out, text, words, matches, items, shared)
        out, count = (scanned, words) if count is None else (scanned.drop(words), count)
        parts.append(matches), named.append(items)
    n_words, found = F.col(count), F.concat(*parts)
    out = out.withColumns({"n_words": n_words, "matches": found, "items": F.array_distinct(F.concat(*named))})
    return out.select(*docs.columns, "n_words", "matches", "items")


def covered(matches: Column) -> Column:
    """How many words lie in any of the matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))
        return F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those in which a window of the benchmark occurs."""
    kept = find(prefixed(docs), benchmark, f"d_{text}").filter(F.size("matches") == 0)
    return restored(kept, docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits per document."""
    found = find(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark)
    hits = found.select("key", "n_words", covered(F.col("matches")).alias("n_hit"), F.array_sort("items").alias("items"))
    return hits.select(
        F.col("key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
