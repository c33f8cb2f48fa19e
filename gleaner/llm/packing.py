"""Best-fit packing of token sequences, with a vector of capacities.

Every piece of a document asks for tokens, one document place and attention
cost (the square of its length). A sequence has a capacity for each. Pieces go
from the longest to the shortest; of the open sequences in which a piece fits
under every constraint, it takes the one with the smallest weighted norm of
what stays free ("norm"), or with the largest weighted dot product of the
demand and what is free ("dot"). Else it opens a new one.

Texts are tokenized and packed where they are read, in blocks of ``BLOCK`` pieces.
Sequences filled to ``FULL`` of their tokens stay as they are. The pieces of all others
are packed anew in further passes, dealt by hash into groups of ``GROUP_TOKENS`` tokens,
until one group holds them all or a pass saves no sequence; only these pieces are
shuffled. Every pass is written to the shared folder, so a lost executor repeats no
earlier pass and ids never change. Sequence ids are the pass, the task or group and a count.

Null and empty texts are documents of the end token alone. Documents of more
than ``capacity`` tokens are cut into full pieces and a rest. Rows with equal or
null keys are packed each for itself; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from gleaner.llm.common import stored
from gleaner.llm.tokens import TokenEncoder

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
BLOCK = 16_384
TEXTS = 256
FULL = 0.99
GROUP_TOKENS = 1 << 22
PASS_BITS, TASK_BITS = 58, 36  # of a sequence id


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, documents: int | None = None,
             attention: float | None = None, rule: str = "norm",
             weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of every piece. Without limits of their own,
    documents and attention are bounded by what ``capacity`` tokens can hold."""
    limits = np.array([capacity, documents or capacity, attention or float(capacity) ** 2], dtype=np.float64)
    asks = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1) / limits
    if (asks > 1).any():
        raise ValueError("a piece is larger than a sequence")
    w = np.array(weights)
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    free = np.ones((3, 1024))
    ids = np.zeros(1024, dtype=np.int64)
    used = np.zeros(len(lengths) + 1, dtype=np.int64)
    n_open = n_all = 0
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min(initial=capacity) / capacity
    slack = 1e-9
    for step, i in enumerate(order):
        if step % 512 == 511:  # sequences that not even the shortest piece fits in
            keep = np.flatnonzero((free[0, :n_open] + slack >= least) & (free[1, :n_open] + slack >= asks[i, 1]))
            free[:, : len(keep)], ids[: len(keep)] = free[:, keep], ids[keep]
            n_open = len(keep)
        ask = asks[i]
        left = free[:, :n_open] - ask[:, None]
        fits = np.flatnonzero(left.min(axis=0) >= -slack) if n_open else ()
        if len(fits):
            if rule == "norm":
                best = fits[np.argmin(w @ left[:, fits] ** 2)]
            else:
                best = fits[np.argmax((w * ask) @ free[:, fits])]
        else:
            if n_open == free.shape[1]:
                free = np.concatenate([free, np.ones_like(free)], axis=1)
                ids = np.concatenate([ids, np.zeros_like(ids)])
            best = n_open
            free[:, best], ids[best] = 1.0, n_all
            n_open, n_all = n_open + 1, n_all + 1
        free[:, best] -= ask
        sequence[i] = ids[best]
        offset[i] = used[ids[best]]
        used[ids[best]] += lengths[i]
    return sequence, offset


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
         capacity: int = CAPACITY, documents: int | None = None, attention: float | None = None,
         rule: str = "norm", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id,
    offset`` and, if asked for, its token ids."""
    limits = (capacity, documents, attention, rule)
    part = stored(_read_and_pack(docs, key, text, tokenizer, limits, with_ids), "packed")
    done: list[DataFrame] = []
    for number in range(1, 1 << (63 - PASS_BITS)):
        tokens, count = part.filter("open").agg(F.sum("length"), F.count_if(F.col("offset") == 0)).first()
        if count <= math.ceil((tokens or 0) / capacity):  # as few as these tokens need
            break
        groups = math.ceil(tokens / GROUP_TOKENS)
        again = stored(_pack_again(part.filter("open"), groups, number, limits), "packed")
        if again.filter("offset = 0").count() >= count:
            break
        done.append(part.filter("NOT open"))
        part = again
        if groups == 1:
            break
    for earlier in done:
        part = part.unionByName(earlier)
    return part.drop("open").withColumnRenamed("key", key)


def _place(length: np.ndarray, first: int, limits: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sequence ids from ``first`` on, offsets, whether the sequence is open, and the next id."""
    sequence, offset = best_fit(length, *limits)
    used = np.bincount(sequence, weights=length)
    return sequence + first, offset, (used < FULL * limits[0])[sequence], first + len(used)


def _pack_again(pieces: DataFrame, groups: int, number: int, limits: tuple) -> DataFrame:
    """Pieces packed anew, each group for itself. Groups are of pieces dealt by hash, so their
    size follows the number of groups whatever the documents are."""
    group = F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)).cast("long")
    names = pieces.columns

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        first = (number << PASS_BITS) + (key[0].as_py() << TASK_BITS)
        part = part.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        sequence, offset, is_open, _ = _place(part["length"].to_numpy(), first, limits)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("open", is_open)):
            part = part.set_column(part.column_names.index(name), name, pa.array(values))
        return part.select(names)

    return pieces.withColumn("group", group).groupBy("group").applyInArrow(run, pieces.schema)


def _read_and_pack(docs: DataFrame, key: str, text: str, tokenizer: str, limits: tuple, with_ids: bool) -> DataFrame:
    capacity = limits[0]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    schema = (
        StructType().add("key", kind).add("piece", "integer").add("start", "long").add("length", "long")
        .add("ids_crc32", "long").add("sequence_id", "long").add("offset", "long")
        .add("open", "boolean")
    )
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenEncoder(tokenizer)
        first = TaskContext.get().partitionId() << TASK_BITS
        keys: list[pa.Array] = []
        pieces: list[tuple] = []
        data: list[bytes] = []

        def packed() -> pa.RecordBatch:
            nonlocal first
            piece, start, length, crc, row = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
            sequence, offset, is_open, first = _place(length, first, limits)
            columns = [
                pa.concat_arrays(keys).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start),
                pa.array(length), pa.array(crc), pa.array(sequence), pa.array(offset), pa.array(is_open),
            ]
            if with_ids:
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(data), dtype="<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), values))
            keys.clear(), pieces.clear(), data.clear()
            return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                row = sum(map(len, keys))
                keys.append(part.column(0))
                for ids in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        pieces.append((piece, start, len(own) // 4, zlib.crc32(own), row))
                        if with_ids:
                            data.append(own)
                    row += 1
                if len(pieces) >= BLOCK:
                    yield packed()
        if pieces:
            yield packed()

    return rows.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, its token ids and the lengths of
    its pieces. Groups are bounded by the capacity of a sequence."""
    part = F.struct("offset", "length", "ids")
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.col("parts.length").alias("lengths"),
        )
    )
