import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators.embedding import batched_embedder, hashing_embedder
from gleaner.plans.ingest import ingest
from gleaner.schemas import CHUNK_KEY, RAW_POST
from gleaner.sources import collections as K, records
from gleaner.sources import export, posts, tables
from gleaner.streaming.ingest import ingest_stream, stream_posts


def test_read_shapes(spark, tmp_path):
    rows = {
        "provider": [{"id": 1, "name": "Acme", "slug": "acme", "content": "<p>Hello</p>", "guid": "http://x/?a=1&amp;b=2"}],
        "review": [{"id": 2, "title": "R", "review": "", "content": "<p>c</p>", "provider": "Acme"}],
        "article": [{"id": 3, "title": "Why RINGCENTRAL", "slug": None, "content": None, "post_date": "2024"}],
    }
    paths = {}
    for kind, records in rows.items():
        paths[kind] = str(tmp_path / f"{kind}.json")
        (tmp_path / f"{kind}.json").write_text(json.dumps(records))
    got = {r.id: r for r in posts.read_posts(spark, paths).collect()}
    assert got["1"].title == got["1"].provider == "Acme" and got["1"].url == "http://x/?a=1&b=2"
    assert got["2"].html == "<p>c</p>" and got["3"].provider == "RingCentral" and got["3"].html == ""
    assert posts.read_posts(spark, paths, "review").count() == 1
    assert posts.get_post(posts.read_posts(spark, paths), 2).first().content_type == "review"
    with pytest.raises(KeyError):
        posts.get_post(posts.read_posts(spark, paths), 2, "article")
    with pytest.raises(Exception):
        posts.read_records(spark, str(tmp_path / "missing.json"), "article").count()


def test_json_lines_and_arrays(spark, tmp_path):
    record = {"id": "1", "title": "t"}
    lines = "\n".join(json.dumps(record | {"id": str(i)}) for i in range(3))
    path = tmp_path / "records.json"
    path.write_text(lines)
    assert posts.read_records(spark, str(path), "article", lines=True).count() == 3
    for text in (lines, json.dumps(record), json.dumps([record]) + "\n" + json.dumps([record]), json.dumps([record]) + " x", ""):
        path.write_text(text)
        with pytest.raises(ValueError, match="not one JSON array"):
            posts.read_records(spark, str(path), "article")
    path.write_text(" \n" + json.dumps([record, record]) + "\n")
    assert posts.read_records(spark, str(path), "article").count() == 2
    rows = spark.range(25).selectExpr("cast(id as string) id", "'a \"quoted\" title' title")
    records.write_json_arrays(rows, str(tmp_path / "arrays"), "id", per_file=10)
    back = posts.read_records(spark, str(tmp_path / "arrays"), "article")
    assert sorted(int(r.id) for r in back.collect()) == list(range(25))


def test_first_post_by_type(spark):
    rows = [("7", t, "s", "h", kind, None, None, None, None) for t, kind in (("p", "provider"), ("r", "review"), ("a", "article"))]
    found = spark.createDataFrame(rows, posts.RAW_POST).repartition(3)
    assert posts.get_post(found, 7).first().content_type == "article"
    assert posts.get_post(found.filter("content_type <> 'article'"), 7).first().content_type == "review"


def test_export(spark):
    table = spark.createDataFrame(
        [
            (1, "provider", "publish", "Acme", "2024-01-01"),
            (2, "user-reviews", "publish", "Good", "2024-01-02"),
            (3, "user-reviews", "publish", "Bad", "2024-01-02"),
            (4, "user-reviews", "draft", "No", "2024-01-05"),
            (5, "blog_post", "publish", "Blog", "2024-01-03"),
        ],
        "ID long, post_type string, post_status string, post_title string, post_date string",
    ).selectExpr("*", "'g' guid", "'n' post_name", "'c' post_content", "null post_excerpt", "post_date post_modified")
    meta = spark.createDataFrame(
        [(1, 2, "provider", "1"), (2, 2, "pros", "a"), (3, 2, "pros", "b"), (4, 3, "provider", "x1"), (5, 1, "meta_description", "d")],
        "meta_id long, post_id long, meta_key string, meta_value string",
    )
    reviews = {r.id: r for r in export.export_reviews(table, meta).collect()}
    assert set(reviews) == {2, 3}
    assert reviews[2].provider == "Acme" and reviews[2].pros == "b" and reviews[2].provider_id == 1
    assert reviews[3].provider == "" and reviews[3].provider_id is None
    assert [r.id for r in export.export_reviews(table, meta, 1).collect()] == [3]
    assert export.export_providers(table, meta).first().meta_description == "d"
    assert export.export_articles(table).first().excerpt == ""


def make_posts(spark, ids, text="Ten dollars a month."):
    rows = [(str(i), f"Post {i}", f"post-{i}", f"<h2>Price</h2><p>{text} {i}</p>", "article", None, None, None, None) for i in ids]
    return spark.createDataFrame(rows, RAW_POST)


def test_ingest_upsert_copy(spark, tmp_path):
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    embed = hashing_embedder(16)
    reports = ingest(make_posts(spark, [1, 2]), root, embed, 16)
    assert {r.document_id: r.chunks for r in reports["fixed_size"].collect()} == {None: 2, "1": 1, "2": 1}
    assert tables.read_chunks(spark, root, "parent_child", parents=True).count() == 2
    assert tables.read_documents(spark, f"{root}/documents", "1").first().name == "article-1-post-1"
    ingest(make_posts(spark, [2, 3], "Now twenty."), root, embed, 16, append=True)
    chunks = K.as_chunks(K.read_points(spark, f"{root}/collections/structure_aware"))
    got = {r.document_id: r.text for r in chunks.collect()}
    assert got == {"1": "Ten dollars a month. 1", "2": "Now twenty. 2", "3": "Now twenty. 3"}
    names = ["structure_aware", "absent"]
    assert K.copy_collections(spark, names, f"{root}/collections", f"{other}/collections", CHUNK_KEY) == {"structure_aware": 3}
    with pytest.raises(ValueError):
        K.copy_collections(spark, names, root, root + "/", CHUNK_KEY)


def test_wrong_width_fails(spark, tmp_path):
    path = str(tmp_path / "c")
    K.ensure_collection(spark, path, 8)
    K.ensure_collection(spark, path, 99)
    assert K.describe(spark, path)[0] == 8
    with pytest.raises(Exception, match="width"):
        ingest(make_posts(spark, [1]), str(tmp_path / "d"), hashing_embedder(4), 8, ("fixed_size",))


def test_stream_is_idempotent(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    root = str(tmp_path / "r")
    for step, ids in enumerate([[1, 2], [2, 3]]):
        rows = make_posts(spark, ids).toJSON().collect()
        (inbox / f"{step}.json").write_text("\n".join(rows))
        query = ingest_stream(stream_posts(spark, str(inbox)), root, str(tmp_path / "cp"), hashing_embedder(8), 8, ("fixed_size",))
        query.awaitTermination(120)
    assert K.read_points(spark, f"{root}/collections/fixed_size").count() == 3


def test_batched_embedder_keeps_order_and_batches(spark, tmp_path):
    log = str(tmp_path / "sizes")

    def call(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a" * i,) for i in range(1, 6)], "t string").coalesce(1)
    got = df.select("t", batched_embedder(call, 2)(F.col("t")).alias("v")).collect()
    assert all(r.v == [float(len(r.t))] for r in got)
    assert sorted(open(log).read().split()) == ["1", "2", "2"]


def test_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"id": "a", "question": "q", "expected_documents": ["1"], "category": "pricing"}]))
    cases = tables.read_cases(spark, str(path))
    assert cases.first().expected_answer is None
    assert [r.category for r in tables.categories_present(cases).collect()] == ["pricing"]
    path.write_text(json.dumps([{"id": "a", "question": "q", "expected_documents": [], "category": "gossip"}]))
    with pytest.raises(Exception, match="unknown category"):
        tables.read_cases(spark, str(path)).collect()


def test_small_batches_leave_the_points_alone(spark, tmp_path):
    path = str(tmp_path / "c")

    def points(ids, text):
        rows = [(f"p{i}", [1.0], "article", "d", i, f"c{i}", None, "t", "s", ["s"], f"{text}{i}", None, None, None) for i in ids]
        return spark.createDataFrame(rows, K.POINT)

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "c" / "points").rglob("*.parquet")}

    def texts():
        return {r.point_id: r.text for r in K.read_points(spark, path).collect()}

    K.ensure_collection(spark, path, 1, buckets=4)
    K.upsert(points(range(40), "a"), path, ["text"])
    before, want = files(), {f"p{i}": f"a{i}" for i in range(40)}
    for batch, ids in (("b", [1, 2]), ("c", [2, 50]), ("c", [2, 50])):
        assert K.upsert(points(ids, batch), path, ["text"]) == 2
        want |= {f"p{i}": f"{batch}{i}" for i in ids}
        assert files() == before and texts() == want
    K.upsert(points(range(8), "d"), path, ["text"])  # now the deltas are merged
    want |= {f"p{i}": f"d{i}" for i in range(8)}
    assert files() != before and texts() == want
    assert not list((tmp_path / "c" / "deltas").rglob("*.parquet"))
    K.upsert(points([3], "e"), path, ["text"])
    assert texts() == want | {"p3": "e3"}
