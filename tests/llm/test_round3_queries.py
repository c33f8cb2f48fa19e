"""Quality rules, whitening and the conversation trie against plain versions of them."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import langid, prefix_trie, quality, queries, whitening
from gleaner.llm.oracle import ORACLE

# --- op11 --------------------------------------------------------------------


def plain_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(hit),
    )


def random_texts():
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "\U0001f600", " ", " ", "\n", "\t", "\x0b", "\x1c", " ", "#", "|"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    return texts + [None, "", "   \n\n", "x", "a b c a b c a b c", "one\n one\none\n\n\n", "퟿\x00 z"]


def test_quality_counts_equal_plain_ones():
    for text in random_texts():
        assert quality.counted((text or "").encode()) == plain_counts(text), repr(text)
    long = "word " * 300_000 + "end"
    assert quality.counted(long.encode())[::4] == (300_001, 300_000)


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    """A text alone, between others and in blocks gets the same n-grams."""
    model = quality.Model(np.random.default_rng(0).normal(size=2 * quality.BUCKETS), 0.5)
    texts = ["some words here", None, "", " ", "x", "Ж words\nsome here ", "a b " * 50]
    together = quality.margins(model, texts)
    assert np.allclose(together, [quality.margins(model, [t])[0] for t in texts])
    # The sum over the features is the margin, and a slow walk over n-grams finds as many of them.
    for text, margin in zip(texts, together, strict=True):
        at, value = quality.features(text)
        assert np.isclose(model.bias + model.weights[at] @ value, margin)
        words = (text or "").split()
        codes, owner = next(quality.blocks([text]))
        found = quality.grams(codes, owner)
        assert len(found[1]) == len(words) + max(0, len(words) - 1)
        assert len(found[3]) == sum(max(0, len(text or "") - n + 1) for n in quality.CHARACTERS)
    monkeypatch.setattr(quality, "BLOCK", 64)
    quality.powers.cache_clear()
    parts = list(quality.cuts("ab " * 100))
    assert "".join(parts) == "ab " * 100 and max(map(len, parts)) <= 64
    assert all(p.endswith(" ") for p in parts)
    assert np.isfinite(quality.margins(model, ["ab " * 100, "y" * 1000])).all()
    quality.powers.cache_clear()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)

    def text(good):
        words = [rng.choice(["river", "stone", "light", "house", "green", "walks"]) + str(rng.randint(0, 99)) for _ in range(70)]
        return " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)

    rows = [(i, text(i % 3 > 0), i % 3 > 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(900, None, "c"), (None, "no id " * 60, "c"), (901, "short", "c"), (902, "again and again " * 60, "c")], "doc_id long, text string, rules string")
    known = [(i, int(good)) for i, _, good in rows if i % 2] + [(None, 1), (1, None), (5000, 0), (3, 0), (3, 0)]
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    return docs, labels, {i: good for i, _, good in rows}


def test_quality_verdicts(spark, labelled):
    docs, labels, good = labelled
    got = {r.doc_id: r for r in quality.digest(docs.union(docs.filter("doc_id = 7")), labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for key, row in got.items():
        counts = plain_counts(texts[key])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert row.kept == (not row.base_failed and row.p_good >= quality.KEEP)
    held = [k for k in good if k % 2 == 0]
    assert sum(got[k].kept == good[k] for k in held) == len(held)
    assert got[902].base_failed and not got[900].kept and len(got) == len(texts)


def test_quality_without_labels_or_rows(spark, labelled):
    docs, labels, _ = labelled
    rows = quality.digest(docs, labels.filter("quality = 1")).collect()
    assert all(r.p_good is None and r.kept != r.base_failed for r in rows)
    assert quality.digest(docs.limit(0), labels.limit(0)).collect() == []
    judged = quality.judged(docs, None)
    assert judged.columns == [*docs.columns, "_rules"]


def test_quality_sample_keeps_both_classes(spark):
    """One id repeated very often neither crowds out others nor gets lost."""
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(3000)] + [(i, "t") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 3000 + [(i, 0) for i in range(2, 40)], "doc_id long, quality int")
    rows = quality.sample(docs, labels).collect()
    assert sorted((r.key, r.good) for r in rows) == [(1, 1)] + [(i, 0) for i in range(2, 40)]
    assert {r.weight for r in rows} == {1.0}


def test_quality_calibration():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=4000)
    good = (rng.random(4000) < 1 / (1 + np.exp(-(2 * margin - 1)))).astype(float)
    model = quality.calibrated(quality.Model(np.zeros(2), 0.0), margin, good, np.ones(4000))
    assert abs(model.slope - 2) < 0.2 and abs(model.shift + 1) < 0.2


# --- op12 --------------------------------------------------------------------


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    y = (x - sums / n) @ directions[:, :k] / np.sqrt(values[:k])
    return n, ((n * x - sums) ** 2).sum(axis=1), y, values[:k] / values.sum()


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)  # many blocks
    rng = np.random.default_rng(2)
    data = [[float(np.float32(c)) for c in rng.normal(scale=s, size=6)] for s in np.linspace(0.2, 2, 60)]
    data += [data[3]] * 30 + [[-0.0] * 6]  # a third are copies
    rows = [(i % 85, v, "x") for i, v in enumerate(data)]  # repeated ids
    bad = [(900, None, "x"), (901, [None] * 6, "x"), (902, [float("nan")] * 6, "x"), (903, [0.1, float("-inf")] + [0.0] * 4, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, at string").repartition(5)
    got = whitening.digest(df).toPandas()
    n, deviation, y, explained = plain_whitening(data)
    assert len(got) == 4 * len(data) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    assert sorted(got[got.component == 1]["deviation"]) == sorted(deviation.tolist())
    for c in range(1, 5):
        part = got[got.component == c]
        assert np.allclose(part["explained"], explained[c - 1], rtol=1e-9)
        mine, theirs = np.sort(part["whitened"]), y[:, c - 1]
        assert np.allclose(mine, np.sort(theirs), atol=1e-8) or np.allclose(mine, np.sort(-theirs), atol=1e-8)


def test_whitening_defined_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.digest(spark.createDataFrame([], schema)).collect() == []
    assert whitening.digest(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.digest(spark.createDataFrame([(1, [0.5, 1.0])] * 3, schema)).collect() == []  # no variance
    # One direction of variance, vectors of two lengths: the shorter is filled up.
    rows = whitening.digest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (None, [1.0, 4.0])], schema)).collect()
    assert sorted((r.component, r.n) for r in rows) == [(1, 3)] * 3 and {round(r.explained, 9) for r in rows} == {1.0}
    assert {r.vec_id for r in rows} == {1, 2, None}
    huge = whitening.digest(spark.createDataFrame([(1, [1e37, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], schema)).collect()
    assert huge and any(r.deviation is None for r in huge)


# --- op13 --------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, at string"


def plain_trie(rows):
    """Every prefix as a tuple of turns, in a dictionary."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(p))
        out.append((
            min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids.get(p, 0), sum(q not in kids for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def conversations(seed, n, long=0):
    rng = random.Random(seed)
    turns = [("user", "a"), ("bot", "b"), ("user", "é" * 3), (None, None), ("", "x" * 40)]
    rows = []
    for c in range(-6, n):
        if rng.random() < 0.15:
            continue
        story = [rng.choice(turns[: 1 + c % 5]) for _ in range(rng.randint(0, 14))]
        rows += [(c, i if rng.random() < 0.95 else None, *t, "clash") for i, t in enumerate(story)]
    hot = [("user", "hot")] * 9
    rows += [(c, i, *t, "clash") for c in range(1000, 1040) for i, t in enumerate(hot)]  # copies
    rows += [(c, i, "user", "step", "clash") for c in range(2000, 2012) for i in range(2 * (c - 1999))]  # a chain of nested ends
    rows += [(None, 0, "user", "no id", "clash"), rows[5], rows[5]]
    rows += [(3000, i, "user", str(i % 7), "clash") for i in range(long)]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_equals_plain_one(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = conversations(seed, 70, long=60)
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    got = sorted(map(tuple, prefix_trie.nodes(df).collect()), key=lambda r: (r[0], r[1]))
    assert got == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))


def test_trie_sql_equals_plain_one(spark, tmp_path):
    rows = conversations(2, 60)
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert sorted(map(tuple, con.execute(ORACLE["op13_prefix_trie"]).fetchall()), key=lambda r: r[:2]) == sorted(
        plain_trie(rows), key=lambda r: r[:2]
    )


def test_trie_of_little(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], TURNS)).collect() == []
    # crc32("3") % 9 turns come from conversation 0, which is absent: none are left.
    rows = [(c, 0, "user", "one", "x") for c in range(1, 5)]
    got = sorted(map(tuple, prefix_trie.nodes(spark.createDataFrame(rows, TURNS)).collect()))
    assert got == sorted(plain_trie(rows))


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)] + [(2**29 - 1, 2**29), (0, 2**30)]
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("f", prefix_trie.fattest(F.col("a"), F.col("b")))
    for a, b, f in df.collect():
        assert f == (b & (-1 << ((a ^ b).bit_length() - 1)))


def test_queries_are_registered():
    assert {"op11_quality", "op12_whitening", "op13_prefix_trie"} <= set(queries.QUERIES)


# --- op2: the sample ---------------------------------------------------------


def test_language_sample_keeps_a_language_of_one_repeated_id(spark):
    """Rows of one id, copies of one row and rows without an id: no language is lost or crowded out."""
    rows = [(7, f"the english text number {i} of one id", "en") for i in range(5000)]
    rows += [(8, "always the same german text", "de")] * 5000
    rows += [(i, f"un texte en français {i}", "fr") for i in range(100, 400)]
    rows += [(None, "sin número", "es"), (9, "12345", "en"), (10, None, "xx"), (11, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    windows, langs = langid.sample(docs)
    counts = {lang: langs.count(lang) for lang in set(langs)}
    assert counts == {"en": langid.FIT_PER_LANG, "de": 1, "fr": 300, "es": 1}
    assert all(len(w) <= langid.WINDOW for parts in windows for w in parts)
    assert (windows, langs) == langid.sample(docs.repartition(3))


def test_language_forward_pass_equals_a_slow_one():
    """Convolution, pooling, softmax and the mean over windows, entry by entry."""
    net = langid.train(["one small text with letters", "ein anderer kleiner text"] * 4, ["en", "de"] * 4)
    for text in ["a", "short text", "ß" * 400, "many words here " * 90]:
        symbols = net.symbol[np.frombuffer(text.lower().encode(), np.uint8)]
        total = np.zeros(2)
        for at in range(0, len(symbols), langid.WINDOW):
            window = np.zeros(langid.WINDOW, dtype=int)
            part = symbols[at : at + langid.WINDOW]
            window[: len(part)] = part
            hidden = []
            for own, bias in zip(net.filters, net.bias, strict=True):
                values = [sum(own[j][window[i + j]] for j in range(len(own))) for i in range(langid.WINDOW - len(own) + 1)]
                hidden.append(max(max(values) + bias, 0))
            z = np.array(hidden) @ net.weights + net.out_bias
            total += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * len(part)
        p = np.exp(total / len(symbols))
        langs, scores = langid.classify(net, [text])
        assert langs[0] == net.labels[int(p.argmax())] and np.isclose(scores[0], p.max() / p.sum(), atol=1e-4)
