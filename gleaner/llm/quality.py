"""Quality rules: counted rules, and a calibrated logistic regression over hashed
word and character n-grams.

Words are runs of characters other than ASCII white space. Features are one-
and two-word n-grams, and runs of two to four characters, hashed into ``BUCKETS`` buckets
each; their values are shares of the text's n-grams of that kind, so that a text's
margin is a sum over its n-grams and long texts are scored in blocks of
bounded size. N-grams do not cross blocks, which end at white space where
there is any.

The regression is fitted by MLlib on the executors, on at most ``FIT_PER_CLASS`` labelled
documents of each class, drawn by the hash of their ids from all of them, one row
per id and label, weighted so that the classes keep their shares of the table. A fifth of
these is held out and calibrates the margins to probabilities (a logistic curve
in the margin). Coefficients are rounded; the order of additions in the cluster may
still move a probability by some 1e-6. The threshold is fixed.

Null texts are empty ones. They and all of fewer than ``MIN_WORDS`` words fail. Labels
that are null or belong to no document teach nothing; an id labelled twice
counts once for each label. Without documents of both classes there is no
regression: its probability is null and the counted rules decide. Repeated rows
get equal results, an empty table none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.common import own_column, stored

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5  # share of words in repeated windows
WINDOW = 3

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS  # of word n-grams, and as many of character n-grams
CHARACTERS = (2, 3, 4)
SCALE = 20.0  # of shares, so that the penalty suits them
PENALTY = 1e-4
ROUNDS = 30
FIT_PER_CLASS = 2_000
KEEP = 0.5
DIGITS = 7

BLOCK = 1 << 19  # characters hashed at once
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Model:
    weights: np.ndarray  # word buckets, then character buckets
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


# --- the counted rules -------------------------------------------------------


def repeated_words(words: np.ndarray) -> int:
    """Places inside windows of ``WINDOW`` word numbers that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    key = words[:n]
    for j in range(1, WINDOW):
        # Numbers of the windows so far and of the next word, made dense again, never overflow.
        both = key * (int(words.max()) + 1) + words[j : j + n]
        key = np.unique(both, return_inverse=True)[1]
    hit = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), dtype=bool)
    for j in range(WINDOW):
        covered[j : j + n] |= hit
    return int(covered.sum())


def counted(data: bytes) -> tuple[int, int, int, int, int]:
    """The counts of one text, in the order of ``COUNTS``."""
    numbers: dict[bytes, int] = {}
    found, lines, dup = [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            dup += line in lines
            lines.add(line)
            found.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    words = np.concatenate(found) if found else np.zeros(0, np.int64)
    solid = np.frombuffer(data.translate(None, BLANKS), np.uint8)
    characters = int(((solid & 0xC0) != 0x80).sum())
    return len(words), characters, len(data) - len(data.translate(None, SYMBOLS)), dup, repeated_words(words)


# --- hashed n-grams ----------------------------------------------------------


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, modulo 2^64."""
    def run(x: int) -> np.ndarray:
        out = np.full(BLOCK + 1, x, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


def bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULTIPLIER
    return ((h ^ (h >> np.uint64(29))) * MULTIPLIER >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def grams(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners and buckets of the word n-grams, and of the character n-grams, of
    neighbouring texts; ``owner`` is the text of every character."""
    up, down = powers()
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.ones(len(codes) + 1, dtype=bool)
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[1:-1] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    solid = ~blank[begin] if len(begin) else np.zeros(0, dtype=bool)
    begin, end = begin[solid], end[solid]
    wide = codes.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(wide * up[: len(codes)], out=sums[1:])
    one = (sums[end] - sums[begin]) * down[begin]
    whose = owner[begin]
    two = one[:-1] * MULTIPLIER + one[1:] * np.uint64(3)
    same = whose[:-1] == whose[1:]
    owners, buckets = [whose, whose[:-1][same]], [bucket(one), bucket(two[same])]
    letters, places = [], []
    run = wide.copy()
    for n in range(2, max(CHARACTERS) + 1):
        if len(codes) < n:
            break
        run = run[:-1] * MULTIPLIER + wide[n - 1 :]
        if n in CHARACTERS:
            inside = owner[: len(run)] == owner[n - 1 :]
            letters.append(owner[: len(run)][inside])
            places.append(bucket(run[inside] + np.uint64(n)))

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return joined(owners), joined(buckets), joined(letters), joined(places)


def cuts(text: str) -> Iterator[str]:
    """Blocks of at most ``BLOCK`` characters, cut behind white space where there is any."""
    at = 0
    while len(text) - at > BLOCK:
        part = text[at : at + BLOCK]
        cut = max(part.rfind(chr(b)) for b in BLANKS) + 1 or BLOCK
        yield part[:cut]
        at += cut
    yield text[at:]


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Characters and their owners, short texts together, long ones in parts."""
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for part in cuts(text or ""):
            if held + len(part) > BLOCK and parts:
                yield _codes(parts), np.repeat(owners, [len(p) for p in parts])
                parts, owners, held = [], [], 0
            parts.append(part), owners.append(i)
            held += len(part)
    if parts:
        yield _codes(parts), np.repeat(owners, [len(p) for p in parts])


def _codes(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def margins(model: Model, texts: list[str | None]) -> np.ndarray:
    """Bias plus the mean weight of the word n-grams and that of the character n-grams."""
    sums, counts = np.zeros((2, len(texts))), np.zeros((2, len(texts)))
    sides = model.weights[:BUCKETS], model.weights[BUCKETS:]
    for codes, owner in blocks(texts):
        found = grams(codes, owner)
        for side in range(2):
            whose, which = found[2 * side : 2 * side + 2]
            sums[side] += np.bincount(whose, weights=sides[side][which], minlength=len(texts))
            counts[side] += np.bincount(whose, minlength=len(texts))
    return model.bias + SCALE * (sums / np.maximum(counts, 1)).sum(axis=0)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and scaled shares of one text."""
    counts = np.zeros(2 * BUCKETS)
    for codes, owner in blocks([text]):
        _, words, _, letters = grams(codes, owner)
        counts[:BUCKETS] += np.bincount(words, minlength=BUCKETS)
        counts[BUCKETS:] += np.bincount(letters, minlength=BUCKETS)
    for side in (counts[:BUCKETS], counts[BUCKETS:]):
        side *= SCALE / max(side.sum(), 1)
    at = np.flatnonzero(counts)
    return at, counts[at]


# --- training ----------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """At most ``FIT_PER_CLASS`` rows ``key, good, text, weight`` of each class."""
    ids = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key")).distinct()
    known = labels.select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("good")).na.drop()
    known = known.distinct().join(ids, "key", "left_semi")
    counts = known.groupBy("good").count()  # two rows at most
    # Of a large class only some ids are ranked, four times as many as are wanted.
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.join(F.broadcast(counts), "good").filter(place * F.col("count") <= 4 * FIT_PER_CLASS)
    drawn = Window.partitionBy("good").orderBy(F.xxhash64("key"), "key")
    some = some.withColumn("n", F.row_number().over(drawn)).filter(F.col("n") <= FIT_PER_CLASS)
    some = some.withColumn("weight", F.col("count") / F.count("*").over(Window.partitionBy("good"))).select("key", "good", "weight")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    # Copies of an id become one row; some holds 2 * FIT_PER_CLASS rows at most.
    return rows.join(F.broadcast(some), "key").groupBy("key", "good", "weight").agg(F.min("text").alias("text"))


def calibrated(model: Model, margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> Model:
    """Slope and shift by Newton steps on the held-out log loss, with a small prior."""
    if len(set(good.tolist())) < 2:
        return model
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    prior, start = np.diag([1e-3, 1e-3]), np.array([1.0, 0.0])
    # Targets short of 0 and 1 keep the curve finite where the classes separate.
    target = np.where(good > 0, (good.sum() + 1) / (good.sum() + 2), 1 / ((1 - good).sum() + 2))
    w, at = weight / weight.mean(), start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + prior, x.T @ (w * (p - target)) + prior @ (at - start))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.weights, model.bias, round(float(at[0]), DIGITS), round(float(at[1]), DIGITS))


def train(rows: DataFrame) -> Model | None:
    """Fit and calibrate on the rows of ``sample``."""
    rows = stored(rows.repartition(8, "key"), "quality-sample")
    held = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(5)) == 0
    fit = rows.filter(~held)
    if fit.select("good").distinct().count() < 2:
        fit = rows
        if fit.select("good").distinct().count() < 2:
            return None

    vector = F.udf(lambda text: Vectors.sparse(2 * BUCKETS, *features(text)), VectorUDT())
    table = fit.select(F.col("good").cast("double").alias("label"), "weight", vector("text").alias("features"))
    table = stored(table, "quality-features")
    found = LogisticRegression(maxIter=ROUNDS, regParam=PENALTY, standardization=False, weightCol="weight").fit(table)
    model = Model(np.round(found.coefficients.toArray(), DIGITS), round(float(found.intercept), DIGITS))
    packed = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*packed.value)
        for batch in batches:
            margin = margins(own, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin)], ["good", "weight", "margin"])

    # A fifth of the sample: numbers only, 2 * FIT_PER_CLASS rows at most.
    check = rows.filter(held).select("good", "weight", "text").mapInArrow(scored, "good int, weight double, margin double")
    check = check.orderBy("margin", "good", "weight").toPandas()
    return calibrated(model, *[check[c].to_numpy(dtype=float) for c in ("margin", "good", "weight")])


# --- scoring -----------------------------------------------------------------


def judged(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with a struct ``rules``: the counts, ``base_failed``, ``p_good`` and ``kept``;
    see ``own_column`` for its name."""
    keep = docs.columns if keep is None else keep
    packed = None if model is None else (model.weights, model.bias, model.slope, model.shift)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            counts = [counted(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
            p = pa.nulls(len(texts), pa.float64()) if own is None else pa.array(own.probability(margins(own, texts)))
            columns.append(p)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *names])

    names = [own_column(docs, c) for c in (*COUNTS, "p_good")]
    schema = StructType([docs.schema[c] for c in keep])
    for name in names[:-1]:
        schema = schema.add(name, "long")
    found = docs.mapInArrow(run, schema.add(names[-1], "double"))
    n, repeated, p = F.col(names[0]), F.col(names[4]), F.col(names[5])
    failed = (n < MIN_WORDS) | (repeated > n * MAX_REPEATED)
    rules = F.struct(
        *[F.col(own).alias(c) for own, c in zip(names, (*COUNTS, "p_good"), strict=True)],
        failed.alias("base_failed"),
        (~failed & (F.coalesce(p, F.lit(1.0)) >= KEEP)).alias("kept"),
    )
    return found.select(*keep, rules.alias(own_column(docs, "rules")))


def digest(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the labelled documents, judge all."""
    model = train(sample(docs, labels, key, text))
    rows = judged(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, keep=["key"])
    return rows.select(F.col("key").alias(key), *[f"rules.{c}" for c in (*COUNTS, "base_failed", "kept", "p_good")])
