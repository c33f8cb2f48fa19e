"""The queries that bring documents together, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import ann, sharding, simhash, suffix_dedup
from gleaner.llm.queries import QUERIES
from .conftest import make_documents


# --- SimHash -------------------------------------------------------------------------


def brute_components(prints: np.ndarray, ids: list, limit: int, nulls_last=True) -> list:
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= limit) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, own in enumerate(ids):
        r = root(i)
        if own is not None:
            least[r] = own if r not in least or least[r] is None else min(least[r], own)
        least.setdefault(r, None)
    return [least[root(i)] for i in range(len(ids))]


def brute_fingerprint(text, shingle=4) -> int:
    from xxhash import xxh64_intdigest

    own = (text or "").encode().lower().split()
    if not own:
        return 0
    n = max(1, len(own) - shingle + 1)
    h = [xxh64_intdigest(b" ".join(own[i : i + shingle]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_query(spark, fixture_dir):
    rows = make_documents()
    prints = np.array([brute_fingerprint(r[1]) for r in rows], dtype=np.uint64)
    components = brute_components(prints, [r[0] for r in rows], 4)
    want = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints.tolist(), components, strict=True))
    assert Counter(tuple(r) for r in QUERIES["op6_simhash"](spark, fixture_dir).collect()) == want


@pytest.mark.parametrize("scheme", [simhash.CONTRACT, simhash.Scheme(8, 5, 1), simhash.Scheme(12, 7, 1)])
def test_no_link_is_lost(spark, scheme):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    found = []
    for i, x in enumerate(base):
        for _ in range(400 if i == 0 else 4):  # one large ball
            bits = rng.choice(64, rng.integers(0, 4 if i == 0 else 14), replace=False)
            found.append(int(x) ^ sum(1 << int(b) for b in bits))
    prints = np.unique(np.array(found, dtype=np.uint64))
    signed = prints.view(np.int64).tolist()
    frame = spark.createDataFrame([(v, v) for v in signed], "fp long, fp2 long")
    links = simhash.links(frame, scheme, 5).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= scheme.limit for r in links)
    assert len(links) <= 5 * len(prints)  # trees, not all pairs
    root = {r.node: r.root for r in simhash.components(simhash.links(frame, scheme, 5)).collect()}
    assert [root.get(v, v) for v in signed] == brute_components(prints, signed, scheme.limit)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=12))
def test_pigeonring_finds_every_pair(a, bits):
    """Two fingerprints within the limit share a key that one files and the other asks."""
    b = a ^ sum(1 << x for x in bits)
    for scheme in (simhash.CONTRACT, simhash.Scheme(8, 5, 1), simhash.COPIES):
        if len(bits) > scheme.limit:
            continue
        one, other = np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64)
        assert any(
            simhash.chain_keys(scheme, other, s)[0] in simhash.chain_keys(scheme, one, s)[0] ^ scheme.masks(s)
            and simhash.linked(simhash.Scheme(scheme.limit, scheme.segments, scheme.depth), one, other, one, other, np.array([s]))[0]
            for s in range(scheme.segments)
        )


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert root == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


def test_one_document_of_each_group(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    kept = simhash.one_of_each(docs, shingle=5)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(v for k, v in ids.items() if k is not None) == 1
    assert [i for i in range(100, 140) if i in ids] == [100]
    assert [i for i in range(200, 208) if i in ids] == [200]
    assert sum(i in ids for i in range(60)) == 60


def test_only_similar_documents_are_removed(spark):
    """Fingerprints this close used to link; shingles decide, at any size of block."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for family, changes in ((0, 12), (1, 4)):  # similarities of about 0.59 and 0.83 between revisions
        for i in range(40):
            own = [f"f{family}{w}" for w in base]
            for at in rng.choice(80, changes, replace=False):
                own[5 * at + 2] = f"new{family}x{i}x{at}"
            texts[100 * family + i] = " ".join(own)
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(396)} for d, t in texts.items()}
    parent = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = {d: low if p == high else p for d, p in parent.items()}
    want = sorted(set(parent.values()))
    assert 40 <= len(want) <= 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs, shingle=5).collect()) == want
    ids = docs.select(F.col("doc_id").alias("id"), "text")
    roots = docs.select(F.col("doc_id").alias("node"), F.floor(F.col("doc_id") / 100).cast("long").alias("root"))
    joined = {r.node: r.root for r in simhash.components(simhash.copies(ids, roots, 5, block=7)).collect()}
    assert {d: joined.get(d, d) for d in texts} == parent


# --- shards ------------------------------------------------------------------------------


def check_shards(rows, documents, shards=40):
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(shards))
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    want = Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in documents)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_shard_query(spark, fixture_dir):
    check_shards(QUERIES["op8_sharding"](spark, fixture_dir).collect(), make_documents())


def test_shards_keep_groups_together(spark):
    texts = [f"alone {i}" for i in range(600)] + [f"pair {i // 3}" for i in range(300)] + ["hot"] * 450
    docs = [(i, t) for i, t in enumerate(texts)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    split = sum(len(s) > 1 for t, s in shards.items() if t.startswith("pair"))
    assert split <= 10
    assert len(shards["hot"]) <= 22  # 450 documents need 14 shards of 34


# --- nearest neighbours ------------------------------------------------------------------


def exact(vectors, queries, k=5):
    ids = [i for i, _ in vectors]
    x = np.array([v for _, v in vectors], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        v = np.array(v, dtype=np.float64)
        scores = x @ (v / np.linalg.norm(v))
        best = sorted((-round(s, 12), i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        out[q] = [i for _, i in best]
    return out


def test_ann_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(32).astype(np.float32).tolist(), 1) for i in range(3000)]
    rows += [(3000 + i, rows[50][1], 2) for i in range(1000)]  # copies of a query
    odd = [(5000, None, 0), (5050, [0.0] * 32, 0), (5051, [None] + [1.0] * 31, 0), (5052, [float("nan")] * 32, 0),
           (5053, [float("inf")] * 32, 0), (None, rows[0][1], 0), (5100, [1.0, 2.0], 0), (5101, [], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    frame.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    found = QUERIES["op5_ann"](spark, str(tmp_path)).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
    vectors = [(i, v) for i, v, _ in rows]
    want = exact(vectors, [(i, v) for i, v in vectors if i % 50 == 0])
    assert set(got) == set(want)
    assert all(len(v) == 5 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])
    assert recall >= 0.9
    assert got[50] == want[50] == [3000, 3001, 3002, 3003, 3004]  # ties to the smaller id
    original = {i: np.array(v, dtype=np.float64) for i, v in vectors}
    for r in found[:200]:
        a, b = original[r.query_id], original[r.vec_id]
        assert math.isclose(r.score, a @ b / math.sqrt(a @ a) / math.sqrt(b @ b), abs_tol=1e-12)


def test_ann_keeps_copies_scanned_last(spark):
    """Smaller ids of exact copies come in later batches; rounding must not abandon them."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((10, 64))
    rows = [(i, base[i % 10].tolist()) for i in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(frame, lists=1)
    last = ann.Index(index.rows.orderBy(F.desc("key")).coalesce(1), index.centers, index.turn)
    asked = frame.filter("vec_id >= 5990")
    got = {}
    for r in sorted(ann.search(last, asked).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [q % 10 + 10 * j for j in range(5)] for q in range(5990, 6000)}


def test_scan_keeps_exact_copies():
    rng = np.random.default_rng(3)
    turn = ann.rotation(64)
    v = ann.unit(rng.standard_normal((400, 64)))
    kth = 2 - 2 * (v * v).sum(axis=1)
    i, j = ann.scan_list(np.concatenate([v @ turn, (v @ turn)[::-1]]), ann.unit(v) @ turn, kth)
    assert {(a, a) for a in range(400)} | {(799 - a, a) for a in range(400)} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_ann_with_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(frame, frame.filter("vec_id = 0")).collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]


def test_scan_abandons_only_far_vectors():
    rng = np.random.default_rng(0)
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    x, q = ann.unit(rng.standard_normal((500, 64))) @ turn, ann.unit(rng.standard_normal((20, 64))) @ turn
    far = 2 - 2 * x @ q.T
    kth = np.sort(far, axis=0)[4]
    i, j = ann.scan_list(x, q, kth)
    near = {(a, b) for a, b in zip(*np.nonzero(far <= kth + 1e-12), strict=True)}
    assert len(near & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.97 * len(near)
    assert len(i) <= len(near) + 5


# --- repeated passages ---------------------------------------------------------------------


def brute_dedup(rows):
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_query(spark, fixture_dir):
    rows = [(r[0], r[1]) for r in make_documents()]
    known = brute_dedup(rows)
    want = Counter((r[0], *known[r]) for r in rows)
    assert Counter(tuple(r) for r in QUERIES["op10_suffix_dedup"](spark, fixture_dir).collect()) == want


@pytest.mark.parametrize("hot_segments", [suffix_dedup.HOT_SEGMENTS, 4, 0])
def test_suffix_dedup_bytes(spark, hot_segments):
    rng = np.random.default_rng(4)
    letters = np.array(list("abc é"))
    passage = ["".join(rng.choice(letters, 160)) for _ in range(4)]
    rows = []
    for i in range(80):
        part = passage[i % 4][rng.integers(0, 40) : rng.integers(110, 160)]
        rows.append((i, "".join(rng.choice(letters, rng.integers(0, 200))) + part + "".join(rng.choice(letters, 60))))
    rows += [(100, "a" * 500), (101, "ab" * 200), (102, "aab" * 99 + "c"), (103, "x" * 100 + "y" * 100 + "x" * 100), (104, "z" * 99)]
    known = brute_dedup(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffix_dedup.dedup(frame, hot_segments=hot_segments).collect()
    for r in out:
        text = dict(rows)[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == known[r.doc_id, text]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


@pytest.mark.parametrize("known", [suffix_dedup.KNOWN_SEGMENTS, 5, 0])
def test_what_repeats_in_one_slice_is_known_to_the_next(monkeypatch, known):
    rng = np.random.default_rng(9)
    anchor = rng.integers(0, 3, 400).astype(np.uint64)
    segment = rng.integers(0, 4, 400).astype(np.uint64)
    d, g, lo = (rng.integers(0, n, 400) for n in (20, 2, 50))
    seen = suffix_dedup.Known(known)
    for a in range(0, 400, 40):
        cut = slice(a, a + 40)
        got = seen.earlier(anchor[cut], segment[cut], d[cut], g[cut], lo[cut])
        before = [*zip(anchor[:a], segment[:a], d[:a], g[:a], lo[:a], strict=True)]
        for i, flag in enumerate(got.tolist(), a):
            smaller = any(x[:2] == (anchor[i], segment[i]) and x[2:] < (d[i], g[i], lo[i]) for x in before)
            assert smaller or not flag
            assert flag or not smaller or known != suffix_dedup.KNOWN_SEGMENTS
        seen.add(anchor[cut], segment[cut], d[cut], g[cut], lo[cut])


def hot_rows(n):
    rng = np.random.default_rng(11)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)])
    passage = " ".join(rng.choice(words, 60))
    return [
        (i, " ".join(rng.choice(words, 150)) + ("" if i % 3 else "\n" + "-" * 500 + "\n" + passage) + " ".join(rng.choice(words, 60)))
        for i in rng.permutation(n).tolist()
    ]


def test_a_hot_run_of_bytes_is_in_no_bucket(spark):
    rows = hot_rows(3000)
    frame = spark.createDataFrame(rows, "d long, text string").repartition(4)
    hashes = suffix_dedup._hash_rows(frame.select("d", F.xxhash64("text").alias("g"), "text"), 40)
    size = sum((F.octet_length(c) for c in suffix_dedup._BLOBS), F.lit(0))
    by_bucket = sorted(r.n for r in hashes.groupBy("bucket").agg(F.sum(size).alias("n")).collect())
    assert len(by_bucket) == 40
    assert by_bucket[-1] < 2 * by_bucket[20]


@pytest.mark.parametrize("slice_bytes", [2 << 20, 3000])
def test_hot_runs_and_passages(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    rows = hot_rows(150)
    known = brute_dedup(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in suffix_dedup.digest(frame).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == known[r.doc_id, dict(rows)[r.doc_id]]


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(6)
    for alphabet in (b"ab", b"abcdefgh"):
        pieces = [bytes(rng.choice(list(alphabet), 100 + int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(30)]
        text = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8) + np.uint8(1)
        size = np.array([len(p) for p in pieces])
        first = np.cumsum(size + 1) - size - 1
        text[first + size] = 0
        order = suffix_dedup.two_stage_order(text, first, size - 100)
        whole = text.tobytes()
        keys = [whole[i : i + 100] for i in order]
        assert keys == sorted(keys)
        want = {int(f) + i for f, s in zip(first, size, strict=True) for i in range(s - 99)}
        assert want <= set(order.tolist())
        assert len(set(order.tolist())) == len(order)
        shared = suffix_dedup.common_prefixes(np.append(text, np.zeros(100, np.uint8)), order)
        for a, b, n in zip(keys, keys[1:], shared[1:].tolist(), strict=False):
            assert n == next((i for i in range(100) if a[i : i + 1] != b[i : i + 1]), 100)


def test_whitening_keeps_its_blocks(spark):
    """Transpose, products and projection read the blocks; they are made once."""
    import numpy as np

    from gleaner.llm import whitening

    rows = spark.createDataFrame([(i, [i, -i, 2 * i]) for i in range(6)], "at long, x array<long>")
    blocks = whitening.block_matrix(rows, np.array([2.5, -2.5, 5.0]), 6)
    assert blocks._java_matrix_wrapper._java_model.blocks().getStorageLevel().useMemory()
    assert np.allclose(whitening.scatter(blocks) / 17.5, np.outer([1, -1, 2], [1, -1, 2]))
