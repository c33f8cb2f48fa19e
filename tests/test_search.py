import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import contains, dense, fusion, lexical, parents, ranking, rerank
from gleaner.operators.embedding import hashing_embedder
from gleaner.plans.retrieval import strategies, strategy_hits
from gleaner.schemas import CHUNK, CHUNK_KEY, FILTER_COLUMNS

WORDS = "phone price plan call team video cost user month fax".split()


@pytest.fixture(scope="module")
def chunk_rows():
    rng = random.Random(1)
    rows = []
    for d in range(12):
        for n in range(3):
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 25)))
            kind = "review" if d % 3 else "article"
            rows.append((kind, str(d), n, f"{kind}_{d}_{n}", f"P{d % 4}", f"Title {d}", f"Section {n}", [f"Title {d}", f"Section {n}"], text, None, None, None))
    # Copies of one chunk: a third of all rows score the same.
    rows += [("article", "copy", n, f"article_copy_{n}", "P0", "Copy", "Same", ["Copy", "Same"], "price plan price", None, None, None) for n in range(18)]
    return rows


@pytest.fixture(scope="module")
def chunks(spark, chunk_rows):
    return spark.createDataFrame(chunk_rows, CHUNK).repartition(3)


QUESTIONS = [(1, "price price of a plan"), (2, "video call"), (3, "nothing known"), (4, "fax $ month")]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


def plain_bm25(rows, query, keep=lambda r: True):
    tokens = [re.findall(r"[a-z0-9$]+", " ".join([r[5], r[6], r[4], r[8]]).lower()) for r in rows]
    avg = sum(map(len, tokens)) / len(rows)
    df = Counter(t for ts in tokens for t in set(ts))
    scored = []
    for r, ts in zip(rows, tokens):
        tf = Counter(ts)
        s = sum(
            math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            for t in re.findall(r"[a-z0-9$]+", query.lower())
            if tf[t]
        )
        if s > 0 and keep(r):
            scored.append((-round(s, 9), r[0], r[1], r[2], r[3]))
    return [x[4] for x in sorted(scored)]


def ids(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("filterable", [True, False])
def test_bm25_equals_brute_force(spark, chunks, chunk_rows, questions, filterable):
    got = ids(lexical.search(lexical.build_index(chunks, filterable), chunks, questions, 5))
    for qid, query in QUESTIONS:
        assert got.get(qid, []) == plain_bm25(chunk_rows, query)[:5]


def test_bm25_in_blocks_is_the_same(spark, chunks, questions):
    index = lexical.build_index(chunks)
    one, _ = lexical.search_keys(index, questions, 5)
    many, _ = lexical.search_keys(index, questions, 5, block_rows=3)
    assert sorted(map(str, one.select("query_id", "rank", *CHUNK_KEY).collect())) == sorted(
        map(str, many.select("query_id", "rank", *CHUNK_KEY).collect())
    )


def test_bm25_filters_and_section_fallback(spark, chunks, chunk_rows):
    rows = [
        (1, "price plan", "P1", None, None, None),
        (2, "price plan", None, "review", None, "SECTION 2"),
        (3, "price plan", None, None, "5", "absent"),
        (4, "price plan", "", None, None, "copy"),
    ]
    asked = spark.createDataFrame(rows, "query_id long, query string, " + ", ".join(f"{c} string" for c in FILTER_COLUMNS))
    got = ids(lexical.retriever(chunks)(asked, 4))
    assert got[1] == plain_bm25(chunk_rows, "price plan", lambda r: r[4] == "P1")[:4]
    assert got[2] == plain_bm25(chunk_rows, "price plan", lambda r: r[0] == "review" and r[6] == "Section 2")[:4]
    assert got[3] == plain_bm25(chunk_rows, "price plan", lambda r: r[1] == "5")[:4]
    assert got[4] == plain_bm25(chunk_rows, "price plan", lambda r: r[1] == "copy")[:4]


def test_saved_index(spark, chunks, questions, tmp_path):
    index = lexical.build_index(chunks)
    lexical.save_index(index, "test_index", str(tmp_path / "index"), buckets=4)
    loaded = lexical.load_index(spark, "test_index")
    assert ids(lexical.search(loaded, chunks, questions)) == ids(lexical.search(index, chunks, questions))
    keys, _ = lexical.search_keys(loaded, questions)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(document_id" not in plan  # the buckets spare the corpus shuffle
    for part in lexical.LexicalIndex._fields:
        spark.sql(f"DROP TABLE test_index_{part}")


def vectors(spark, n=200, copies=70):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)], f"L{i % 3}") for i in range(n)]
    same = [float(x) for x in rng.normal(size=6)]
    rows += [(n + i, same, "L0") for i in range(copies)] + [(n + copies, [0.0] * 6, "L1")]
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>, label string").repartition(3)


def plain_nearest(rows, vector, k, keep=lambda r: True):
    v = np.array(vector) / (np.linalg.norm(vector) or 1)
    scored = []
    for r in rows:
        e = np.array(r[1], dtype=np.float32).astype(float)
        scored += [(-round(float(e @ v) / (np.linalg.norm(e) or 1), 9), r[0])] if keep(r) else []
    return [i for _, i in sorted(scored)[:k]]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_nearest_equals_brute_force(spark, block_bytes):
    rows, table = vectors(spark)
    asked = [(i, r[1], r[2] if i % 2 else None) for i, r in enumerate(rows[::25])] + [(99, rows[-2][1], "L0")]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>, filter_label string")
    hits, n = dense.nearest(table, queries, 6, ["id"], filters={"label": "filter_label"}, block_bytes=block_bytes)
    got = ids(hits)
    assert n == len(asked)
    for qid, vector, label in asked:
        v = np.array(vector, dtype=np.float32).astype(float)
        assert got[qid] == plain_nearest(rows, v, 6, lambda r: label is None or r[2] == label)


def ranking_rows(spark, lists):
    rows = [(1, n, rank, i, f"doc {i}") for n, ranked in enumerate(lists) for rank, i in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "query_id long, list_no int, rank int, id string, text string")


def test_fusion_scores_ties_and_duplicates(spark):
    rows = fusion.reciprocal_rank_fusion(ranking_rows(spark, [["a", "b"], ["a", "c"]])).orderBy("rank").collect()
    assert [(r.id, round(r.score, 9)) for r in rows] == [("a", round(2 / 61, 9)), ("b", round(1 / 62, 9)), ("c", round(1 / 62, 9))]
    twice = fusion.reciprocal_rank_fusion(ranking_rows(spark, [["x", "y", "y"]])).orderBy("rank").collect()
    assert [r.id for r in twice] == ["y", "x"]


def pool(spark):
    rows = [(1, r, 1.0, f"c{r}", "T", "S", t) for r, t in enumerate(["a b", "c", "a", "b c a", ""], 1)]
    return spark.createDataFrame(rows, "query_id long, rank int, score double, id string, title string, section string, text string")


def test_rerankers(spark):
    hits, asked = pool(spark), spark.createDataFrame([(1, "A b?")], "query_id long, query string")
    assert ids(rerank.lexical_rerank(hits, asked, 4))[1] == ["c1", "c4", "c3", "c2"]
    by_length = rerank.pair_rerank(lambda q, t: -F.length(t))
    assert ids(by_length(hits, asked, 2))[1] == ["c5", "c2"]
    assert rerank.pair_rerank(None) is rerank.lexical_rerank
    line = rerank.rerank_prompts(hits, 3).first().passages.split("\n")[3]
    assert line == "3. T / S: b c"


@pytest.mark.parametrize(
    "response,expected",
    [
        ('{"order": [2, 0, 2, 9]}', ["c3", "c1", "c2"]),
        ("[4.9, \"1\", true]", ["c5", "c2", "c1"]),
        ('{"order": [1, "x"]}', ["c1", "c4", "c3"]),
        ('{"order": []}', ["c1", "c4", "c3"]),
        ('{"rank": [1]}', ["c1", "c4", "c3"]),
        ("oops", ["c1", "c4", "c3"]),
        (None, ["c1", "c4", "c3"]),
    ],
)
def test_listwise(spark, response, expected):
    asked = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    answers = spark.createDataFrame([(1, response)], "query_id long, response string")
    rows = rerank.listwise_rerank(pool(spark), asked, answers, 3).orderBy("rank").collect()
    assert [r.id for r in rows] == expected
    if expected[0] != "c1" or expected[1] == "c2":
        assert [r.score for r in rows] == [5.0, 4.0, 3.0]


def test_parent_expansion(spark):
    hits = spark.createDataFrame(
        [
            (1, 1, 0.95, "article", "1", 0, "k1", None, "T", "S", ["T"], "child one", None, None, "p1"),
            (1, 2, 0.9, "article", "1", 1, "k2", None, "T", "S", ["T"], "orphan", None, None, "gone"),
            (1, 3, 0.8, "article", "1", 2, "k3", None, "T", "S", ["T"], "sibling", None, None, "p1"),
            (1, 4, 0.7, "article", "2", 0, "k4", None, "T", "S", ["T"], "plain", None, None, None),
        ],
        "query_id long, rank int, score double, " + CHUNK,
    )
    store = spark.createDataFrame(
        [("article", "1", n, "p1", None, "T", "S", ["T"], t, None, None, None) for n, t in enumerate(["first", "last"])], CHUNK
    )
    rows = parents.expand_to_parents(hits, store, 4).orderBy("rank").collect()
    assert [(r.rank, r.id, r.text, r.score) for r in rows] == [
        (1, "p1", "last", 0.95),
        (2, "k2", "orphan", 0.9),
        (3, "k4", "plain", 0.7),
    ]


def test_strategies_at_once_equal_single_searches(spark, chunks, questions):
    embed = hashing_embedder(32)
    points = chunks.withColumn("embedding", embed(F.col("text")))
    near, exact = dense.retriever(points, embed), lexical.retriever(chunks)
    together = strategy_hits(questions, near, exact, 4)
    for name, search in strategies(near, exact).items():
        assert ids(together[name]) == ids(search(questions, 4)), name


def test_multi_query(spark, chunks):
    subs = spark.createDataFrame(
        [(1, 0, 1, "price plan"), (2, 0, 2, "price plan"), (2, 1, 2, "video")], "query_id long, sub_no int, n_subs int, query string"
    )
    search = lexical.retriever(chunks)
    rows = fusion.multi_query_search(search, subs, 5)
    single = search(subs.filter("query_id = 1").select("query_id", "query"), 5)
    assert [(r.id, round(r.score, 9)) for r in rows.filter("query_id = 1").orderBy("rank").collect()] == [
        (r.id, round(r.score, 9)) for r in single.orderBy("rank").collect()
    ]
    fused = rows.filter("query_id = 2").orderBy("rank").collect()
    assert len(fused) == 5 and all(r.score <= 2 / 61 for r in fused)


def test_section_hint_on_short_lists(spark):
    rows = [(q, r, "S" if r % 2 else "Other", ["T", "Deep Heading"] if r == 4 else ["T"], h) for q, h in [(1, "deep"), (2, "absent"), (3, None)] for r in range(1, 6)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, section string, heading_path array<string>, filter_section string")
    got = ranking.apply_section_hint(hits, 3).groupBy("query_id").count().collect()
    assert dict(map(tuple, got)) == {1: 1, 2: 3, 3: 3}


def test_occurrences(spark):
    texts = spark.createDataFrame([(1, "costs and more"), (2, "cost"), (3, None)], "k long, text string")
    needles = spark.createDataFrame([("cost",), ("costs",), ("and more",), ("zzz",), ("",)], "needle string")
    got = {(r.k, r.needle) for r in contains.occurrences(texts, needles, ["k"]).collect()}
    assert got == {(1, "cost"), (1, "costs"), (1, "and more"), (2, "cost")}
    assert {r.needle for r in contains.present(texts, needles).collect()} == {"cost", "costs", "and more"}
