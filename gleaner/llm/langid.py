"""Language ID by a byte convolutional network, written in numpy.

Bytes become ``SYMBOLS`` symbols (the commonest of the sample and one for the
rest). Filters of several widths slide over windows of ``WINDOW`` bytes, the maximum
of each over the window passes a rectifier, and a softmax layer gives the
languages. A text is cut into windows from end to end, the windows are applied
in batches, and their log probabilities are averaged by their length.

Training takes at most ``FIT_DOCS`` labelled documents, at most ``FIT_PER_LANG`` of each
of the ``FIT_LANGS`` most frequent languages, drawn by the hash of id and text from
all of them; rows with equal id, text and label count as one. Of each, ``FIT_WINDOWS`` windows
from places spread over the text are cut on the executors and gathered, some 16 MB
at most. The network is fitted on the driver. The
prediction sees the text alone.

Null texts, empty ones and those without a letter are ``und`` with score 0; so is
everything if nothing is labelled. A null label is not learned. Repeated rows
get equal results, an empty table none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WINDOW = 256
SYMBOLS = 64
WIDTHS = (2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4)
FIT_DOCS = 8_000
FIT_PER_LANG = 400
FIT_LANGS = 1_000
FIT_WINDOWS = 8
FIT_ROUNDS = 6
BATCH = 128
RATE = 0.01
SEED = 11
WINDOWS_AT_ONCE = 512
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    symbol: np.ndarray  # of every byte; 0 pads
    filters: list[np.ndarray]  # (width, symbols) each
    bias: np.ndarray
    weights: np.ndarray  # (filters, labels)
    out_bias: np.ndarray


def cut(symbols: np.ndarray) -> np.ndarray:
    """A text's symbols as windows from end to end, the last one padded."""
    rows = -(-len(symbols) // WINDOW)
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[: len(symbols)] = symbols
    return out.reshape(rows, WINDOW)


def responses(net: Network, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The maximum of every filter in every window, and its place if asked for.

    Two neighbouring symbols are looked up at once, in a table per filter."""
    pair = windows[:, :-1].astype(np.int32) * SYMBOLS + windows[:, 1:]
    single = windows.astype(np.int32)
    best = np.empty((len(windows), len(net.filters)), dtype=np.float32)
    place = np.empty(best.shape, dtype=np.int64) if where else None
    for f, own in enumerate(net.filters):
        width = len(own)
        n = WINDOW - width + 1
        value = np.take((own[0][:, None] + own[1][None, :]).ravel(), pair[:, :n])
        if width == 3:
            value += np.take(own[2], single[:, 2:])
        elif width == 4:
            value += np.take((own[2][:, None] + own[3][None, :]).ravel(), pair[:, 2:])
        if where:
            place[:, f] = value.argmax(axis=1)
            best[:, f] = np.take_along_axis(value, place[:, f : f + 1], axis=1)[:, 0]
        else:
            best[:, f] = value.max(axis=1)
    return best + net.bias, place


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    best, _ = responses(net, windows)
    return log_softmax(np.maximum(best, 0) @ net.weights + net.out_bias)


def _encoded(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)


def spread(text: str | None) -> list[bytes]:
    """``FIT_WINDOWS`` windows from one end of a text to the other; none without a letter."""
    data = _encoded(text)
    places = np.linspace(0, max(0, len(data) - WINDOW), FIT_WINDOWS).astype(int)
    return [data[at : at + WINDOW].tobytes() for at in places] if has_letter(text) else []


def train(texts: list[str | list[bytes]], langs: list[str]) -> Network | None:
    """Fit the network on windows of labelled texts, or on such windows (``spread``), with Adam."""
    labels = sorted(set(langs))
    rows = [(t if isinstance(t, list) else spread(t), labels.index(lang)) for t, lang in zip(texts, langs, strict=True)]
    rows = [r for r in rows if r[0]]
    if not rows:
        return None
    rng = np.random.default_rng(SEED)
    counts = sum(np.bincount(np.frombuffer(w, np.uint8), minlength=256) for parts, _ in rows for w in parts)
    symbol = np.full(256, SYMBOLS - 1, dtype=np.uint8)
    symbol[np.argsort(-counts, kind="stable")[: SYMBOLS - 2]] = np.arange(1, SYMBOLS - 1)
    windows, target = [], []
    for parts, label in rows:
        for part in parts:
            # Some windows are short, as short texts are.
            size = WINDOW if rng.random() < 0.6 else int(rng.integers(12, WINDOW))
            windows.append(cut(symbol[np.frombuffer(part, np.uint8)[:size]])[:1])
            target.append(label)
    x, y = np.concatenate(windows), np.array(target)
    share = 1 / np.maximum(np.bincount(y, minlength=len(labels)), 1)
    weight = share[y] / share[y].mean()
    net = Network(
        labels, symbol, [rng.normal(0, 0.3, (w, SYMBOLS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS), dtype=np.float32),
        rng.normal(0, 0.3, (len(WIDTHS), len(labels))).astype(np.float32), np.zeros(len(labels), dtype=np.float32),
    )
    for own in net.filters:
        own[:, 0] = 0
    params = [*net.filters, net.bias, net.weights, net.out_bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for turn in range(FIT_ROUNDS):
        rate = RATE * (1 - turn / FIT_ROUNDS)
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            best, place = responses(net, x[part], where=True)
            hidden = np.maximum(best, 0)
            delta = np.exp(log_softmax(hidden @ net.weights + net.out_bias))
            delta[np.arange(len(part)), y[part]] -= 1
            delta *= (weight[part] / len(part))[:, None]
            back = (delta @ net.weights.T) * (best > 0)
            grads = [np.zeros_like(f) for f in net.filters]
            for f, grad in enumerate(grads):
                for j in range(len(grad)):
                    seen = x[part, place[:, f] + j]
                    grad[j] += np.bincount(seen, weights=back[:, f], minlength=SYMBOLS)
                    grad[j, 0] = 0
            grads += [back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def classify(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and probability of whole texts."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    able = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
    symbols = [net.symbol[_encoded(texts[i])] for i in able] if able else []
    pending: list[np.ndarray] = []
    owners: list[int] = []
    sums = np.zeros((len(able), len(net.labels) if net else 0))
    held = 0

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        windows = np.concatenate(pending)
        own = np.repeat(owners, [len(p) for p in pending])
        for at in range(0, len(windows), WINDOWS_AT_ONCE):
            block = windows[at : at + WINDOWS_AT_ONCE]
            share = (block > 0).sum(axis=1, keepdims=True)
            np.add.at(sums, own[at : at + WINDOWS_AT_ONCE], log_probabilities(net, block) * share)
        pending.clear(), owners.clear()
        held = 0

    for n, s in enumerate(symbols):
        pending.append(cut(s)), owners.append(n)
        held += len(pending[-1])
        if held >= WINDOWS_AT_ONCE:
            flush()
    flush()
    for n, i in enumerate(able):
        p = np.exp(log_softmax(sums[n : n + 1] / len(symbols[n]))[0])
        langs[i], scores[i] = net.labels[int(p.argmax())], float(p.max())
    return langs, scores


def remainder(key: str) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[list[bytes]], list[str]]:
    """Windows and languages of the bounded sample that training takes, drawn by hash from ``docs``."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    narrow = rows.select("lang", "h").distinct()
    # Of a frequent language only some documents are looked at, by their hash: four
    # times as many as are wanted, whatever the size of the table.
    counts = narrow.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LANGS)
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = narrow.join(F.broadcast(counts), "lang").filter(place * F.col("count") <= 4 * FIT_PER_LANG)
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    some = some.filter(F.col("n") <= FIT_PER_LANG).orderBy("n", "lang").limit(FIT_DOCS).select("lang", "h")
    # FIT_DOCS rows at most, one for all equal ones; then windows instead of texts.
    one = rows.join(F.broadcast(some), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(spread)

    windows.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    cut_up = F.pandas_udf(windows, "array<binary>")
    found = one.select("lang", "h", cut_up("text").alias("windows")).orderBy("h", "lang").collect()
    return [[bytes(w) for w in r["windows"]] for r in found], [r["lang"] for r in found]


def predict(docs: DataFrame, net: Network | None, text: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    # Plain arrays travel, so that workers need no class of this module.
    packed = None if net is None else (net.labels, net.symbol, net.filters, net.bias, net.weights, net.out_bias)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None if shared.value is None else Network(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, WINDOWS_AT_ONCE):
                part = whole.slice(at, WINDOWS_AT_ONCE)
                found, scores = classify(net, part.column(part.schema.get_field_index(text)).to_pylist())
                columns = [*part.columns, pa.array(found, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, lang, score])

    return docs.mapInArrow(run, StructType(list(docs.schema)).add(lang, "string").add(score, "double"))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the documents outside the held-out fold, predict all."""
    net = train(*sample(docs.filter(remainder(key) != 1), key, text, lang))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = predict(rows, net).drop("text")
    return found.select(
        F.col("key").alias(key),
        (remainder("key") == 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
