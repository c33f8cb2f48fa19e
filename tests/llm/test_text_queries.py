"""The queries over single documents, against brute force."""

import hashlib
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import decontam, langid, licenses, packing, pii
from gleaner.llm.queries import QUERIES
from .conftest import make_documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def rows_of(frame, key="doc_id"):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


# --- personal data -----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_pii_query(spark, fixture_dir):
    got = rows_of(QUERIES["op3_pii"](spark, fixture_dir).drop("spans"))
    want = Counter()
    for doc_id, text, *_ in make_documents():
        spans = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == k for s in spans) for k in PATTERNS]
        want[(doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert got == want


def test_pii_checksums_context_and_redaction(spark):
    texts = [
        ("iban DE89370400440532013000 DE88370400440532013000", "iban [IBAN] DE88370400440532013000"),
        ("social security 123-45-6789", "social security [SSN]"),
        ("part no. 123-45-6789", "part no. 123-45-6789"),
        ("a@b.co, 1.2.3.4; \U0001f600 +44 20 7946 0958!", "[EMAIL], [IP]; \U0001f600 [PHONE]!"),
        ("a@b.c%d@e.f x@@y.z", "[EMAIL][EMAIL] x@@y.z"),
        (None, None),
        ("", ""),
        ("9" * 50_000 + "a" * 50_000, "9" * 50_000 + "a" * 50_000),
    ]
    docs = spark.createDataFrame([(i, t, "kept") for i, (t, _) in enumerate(texts)], "doc_id long, text string, pii string")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert [out[i].text for i in range(len(texts))] == [t for _, t in texts]
    assert {r.pii for r in out.values()} == {"kept"}


# --- licenses ------------------------------------------------------------------

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def test_many_addresses(spark):
    """40,000 spans and parts of many sizes in one text, marked and digested."""
    some = ["write to a.b@mail.example.org, ", "or é 1.2.3.4 ", "x" * 5000, " call +49 30 1234567 or 4111 1111 1111 1111; "]
    n = 10_000
    text = "".join(some[:2] + some[3:]) * n + "".join(some) * 3
    docs = spark.createDataFrame([(1, "".join(some)), (2, text)], "doc_id long, text string")
    start = time.time()
    few, many = pii.digest(docs).orderBy("doc_id").collect()
    marked = pii.redact(docs).orderBy("doc_id").collect()
    assert time.time() - start < 120
    assert [getattr(many, f"n_{k}") for k in pii.BASE] == [(n + 3) * getattr(few, f"n_{k}") for k in pii.BASE]
    found = [(k, m.start(), m.end()) for k, p in (("email", "a.b@mail.example.org"), ("ip", "1.2.3.4"))
             for m in re.finditer(re.escape(p), text)]
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in many.spans.split(","))]
    assert [s for s in spans if s[0] in ("email", "ip")] == found
    last, want = 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            want += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    assert marked[1].text == "".join(want) + text[last:]
    assert marked[0].text.startswith("write to [EMAIL], or é [IP] xxx")


def test_license_query(spark, fixture_dir):
    rows = QUERIES["op4_licenses"](spark, fixture_dir).collect()
    got = Counter(tuple(r)[:6] for r in rows)
    want = Counter()
    for doc_id, text, *_ in make_documents():
        own = words(text)
        hits = [(i, label) for p, label in BASE.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        labels = ",".join(sorted({label for _, label in hits}))
        want[(doc_id, len(own), len(hits), min(at, default=None), max(at, default=None), labels)] += 1
    assert got == want
    for r in rows:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in rows}
    assert by_id[309].labels == "apache-2,cc-by-nc,cc-by-nc-sa,mit"


def test_license_rules():
    rules = licenses.rules()
    assert len(rules) > 300
    for rule in rules:
        re.compile(rule.pattern)


def matches_of(parsed) -> list[str]:
    """Texts that a pattern matches: every choice and every optional part, with and without."""
    out = [""]
    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL":
            ends = [chr(value)]
        elif kind == "ANY":
            ends = ["x"]
        elif kind == "IN":
            ends = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in value]
        elif kind == "SUBPATTERN":
            ends = matches_of(value[3])
        elif kind == "BRANCH":
            ends = [m for branch in value[1] for m in matches_of(branch)]
        else:
            low, high, inner = value
            assert kind in ("MAX_REPEAT", "MIN_REPEAT")
            ends = [m * n for n in {low, min(high, low + 1)} for m in matches_of(inner)]
        out = [a + b for a in out for b in ends]
    return out


@pytest.mark.parametrize("rule", licenses.rules(), ids=lambda r: r.pattern)
def test_license_gates_pass_every_match(rule):
    for text in matches_of(re._parser.parse(rule.pattern)):
        words_ = f" {text} "
        assert re.search(f"(?<= )(?:{rule.pattern})(?= )", words_)
        assert rule.gate in words_ and rule.literal in words_ and re.search(licenses.PREFILTER, words_)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("SPDX-License-Identifier: GPL-3.0", "gpl-3"),
        ("Permission is hereby granted, free of charge, to any person", "mit"),
        ("Licensed under the Mozilla Public License, version 2.0", "mpl-2"),
        ("the gnu lesser general public license", "lgpl"),
        ("Released under the Expat license", "mit"),
        ("licensed under the X11 license", "mit"),
        ("the PSF license", "psf-2"),
        ("under the terms of the SIL Open Font license", "ofl-1.1"),
        ("the EUPL-1.2 license", "eupl-1.2"),
        ("SPDX-License-Identifier: MS-PL", "ms-pl"),
        ("this is mitigated by general publication", ""),
    ],
)
def test_license_labels(spark, text, label):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.digest(docs).first().labels == label


def test_many_mentions_of_licenses(spark):
    """40,000 mentions in one text, blocks of detections and all: as in a short text."""
    some = "under the mit license, licensed under the apache license version 2.0; "
    n = 20_000
    docs = spark.createDataFrame([(1, some), (2, some * n), (3, "gpl v3 " * 700)], "doc_id long, text string")
    start = time.time()
    few, many, one = licenses.digest(docs).orderBy("doc_id").collect()
    assert time.time() - start < 180
    assert (many.labels, many.base_labels, many.score) == (few.labels, few.base_labels, few.score)
    assert many.n_base == n * few.n_base and many.n_words == n * few.n_words
    assert (many.first_word, many.last_word) == (few.first_word, few.last_word + (n - 1) * few.n_words)
    spans = [d.split(":") for d in few.detections.split(",")]
    wanted = [f"{s}:{int(a) + i * few.n_words}:{int(b) + i * few.n_words}" for i in range(n) for s, a, b in spans]
    assert many.detections.split(",") == wanted
    assert len(one.detections.split(",")) == 700


# --- packing -------------------------------------------------------------------


def test_packing_query(spark, fixture_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = QUERIES["op1_packing"](spark, fixture_dir).collect()
    want = Counter()
    for doc_id, text, *_ in make_documents():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start : start + 2048], dtype="<u4")
            want[(doc_id, piece, start, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= np.ceil(sum(r.length for r in rows) / 2048) + 1


def test_packed_ids(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet").select("doc_id", "text")
    packed = packing.pack(docs)
    ids = sum(len(r.ids) for r in packed.collect())
    sequences = packing.sequences(packed).collect()
    assert sum(len(s.ids) for s in sequences) == ids
    assert all(len(s.ids) == sum(s.lengths) <= packing.CAPACITY for s in sequences)


@pytest.mark.parametrize(("group_tokens", "documents", "spare"), [(1 << 22, None, 1), (20_000, None, 5), (1 << 22, 4, None)])
def test_many_partitions_fill_their_sequences(spark, monkeypatch, group_tokens, documents, spare):
    """Tasks that read a handful of texts each: what they leave open is packed together."""
    monkeypatch.setattr(packing, "GROUP_TOKENS", group_tokens)
    docs = spark.range(600).selectExpr("id doc_id", "repeat('word ', int(1 + pmod(xxhash64(id), 700))) text", "1 open", "2 key")
    rows = packing.pack(docs.repartition(100), documents=documents).collect()
    assert sorted((r.doc_id, r.piece) for r in rows) == [(i, 0) for i in range(600)]
    sequences = {}
    for r in rows:
        assert len(r.ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
        assert documents is None or len(parts) <= documents
    least = max(np.ceil(sum(r.length for r in rows) / 2048), 600 / (documents or 600))
    assert len(sequences) <= (least + spare if spare else 1.1 * least)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 700)
    lengths[:200] = rng.integers(1, 40, 200)
    limit = 2.0 * 2048 * 800
    for documents, attention in ((None, None), (3, None), (None, limit * 1.3)):
        sequence, offset = packing.best_fit(lengths, 2048, documents, attention, rule)
        for s in range(sequence.max() + 1):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(offset[own])]
            assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all()
            assert lengths[own].sum() <= 2048
            assert documents is None or len(own) <= documents
            assert attention is None or (lengths[own].astype(float) ** 2).sum() <= attention or len(own) == 1
    sequence, _ = packing.best_fit(lengths, rule=rule)
    assert sequence.max() + 1 <= 1.03 * max(lengths.sum() / 2048, (lengths > 1024).sum())


# --- language ID -----------------------------------------------------------------


def test_language_query(spark, fixture_dir):
    rows = QUERIES["op2_language"](spark, fixture_dir).collect()
    texts = Counter((r[0]) for r in make_documents())
    assert Counter(r.doc_id for r in rows) == texts
    lang = {r[0]: (r[1], r[2]) for r in make_documents()}
    for r in rows:
        text, label = lang[r.doc_id]
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 300:
            assert r.lang_pred == label
        if r.doc_id in (300, 301, 302, 303):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op2_language"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id")
    right, n = found.selectExpr("avg(cast(lang = lang_pred as int))", "count(*)").first()
    assert n > 200
    assert right > 0.97


def test_language_gradient():
    """One step of training lowers the loss, and whole texts count, not beginnings."""
    texts = ["abc def " * 50, "xyz uvw " * 50] * 20
    net = langid.train(texts, ["a", "x"] * 20)
    assert langid.classify(net, ["abc", "xyz", None, "!!"])[0] == ["a", "x", "und", "und"]
    assert langid.classify(net, ["abc def " * 40 + "xyz uvw " * 4000])[0] == ["x"]
    assert langid.train([], []) is None


# --- decontamination ---------------------------------------------------------------


def brute_hits(documents, items, window=10):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    for doc_id, text, *_ in documents:
        own, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                names = windows.get(tuple(own[i : i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(own), len(hit), len(found), digest, bool(hit)


def test_decontamination_query(spark, fixture_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{fixture_dir}/benchmark.parquet").collect()]
    got = rows_of(QUERIES["op7_decontamination"](spark, fixture_dir))
    assert got == Counter(brute_hits(make_documents(), items))


def test_decontamination_in_blocks(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{fixture_dir}/benchmark.parquet")
    small = docs.select("doc_id", "text")
    one, many = decontam.find(small, benchmark), decontam.find(small, benchmark, block_bytes=1)
    count = lambda df: Counter((r.doc_id, r.n_words, tuple(sorted(map(tuple, r.matches)))) for r in df.collect())
    assert count(one) == count(many)
    best = {r.doc_id: max((m.n_words for m in r.matches), default=0) for r in one.collect()}
    assert best[305] == 13
    assert decontam.clean(docs, benchmark).columns == docs.columns
    assert {305, 306} & {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == set()


def brute_matches(text, items, window=10):
    """The longest match from each hit place on, read from left to right, for each length of windows."""
    own, texts, out = words(text), [(n, words(t)) for n, t in sorted(items)], []
    for n in sorted({min(window, len(t)) for _, t in texts if t}):
        of_n = [(name, t) for name, t in texts if min(window, len(t)) == n]

        def longest(p):
            best = (0, None, None)
            for name, t in of_n:
                for j in range(len(t) - n + 1):
                    m = 0
                    while p + m < len(own) and j + m < len(t) and own[p + m] == t[j + m]:
                        m += 1
                    if m >= n and m > best[0]:
                        best = (m, name, j)
            return best

        p = 0
        while p + n <= len(own):
            m, name, j = longest(p)
            if m:
                out.append((name, p, j, m))
                p += m - n
            p += 1
    return sorted(out)


def test_matches_are_the_longest_of_one_item(spark):
    rng = np.random.default_rng(12)
    line = [f"w{i}" for i in range(14)]
    items = [(str(i), " ".join([*line, *(f"x{v}" for v in rng.integers(0, 3, 30))])) for i in range(6)]
    items += [("a", "na " * 25), ("b", "na na"), ("b", " ".join(line[2:]))]
    texts = [" ".join([*line[rng.integers(0, 3) :], *t.split()[14 : 14 + rng.integers(0, 30)], *line]) for _, t in items]
    texts += ["na " * 70, "", None, "na na", items[0][1] + " " + items[1][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for r in decontam.find(docs, benchmark).collect():
        assert sorted(map(tuple, r.matches)) == brute_matches(r.text, items)
        brute = next(brute_hits([(r.doc_id, r.text)], items))
        assert len(r.items) == brute[3] and len(set(r.items)) == brute[3]
    assert rows_of(decontam.digest(docs, benchmark)) == Counter(brute_hits(enumerate(texts), items))


def test_a_line_of_all_items_makes_no_pairs():
    line = " ".join(f"w{i}" for i in range(12))
    items = [(str(i), f"{line} own{i} words{i}") for i in range(2000)]
    vocabulary, names, begin, owner, windows = decontam.index_items(items, 10)
    one = [vocabulary[w] for w in line.encode().split()] * 300 + [0]
    (place, item_place, length), found = decontam.shard_matches(
        np.array(one * 20, dtype=np.uint32), np.arange(20) * len(one), windows
    )
    assert len(place) == 20 * 300 and set(length.tolist()) == {12} and set(item_place.tolist()) == {0}
    assert [len(x) for x in found] == [2000] * 20
