"""WARC archives and the corpus pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import warc
from gleaner.llm.common import shared_folder
from gleaner.llm.queries import QUERIES
from .conftest import ITEM, make_documents
from .test_text_queries import base_spans

LONG = "<p>" + "payload " * 40 + "</p>"
PAGES = [
    (5, "http://www.a.example/x?b=2&a=1", LONG, "clash"),
    (3, "https://b.example:8080/x/", LONG, "clash"),
    (9, "http://c.example", LONG, None),
    (1, None, None, None),
    (2, "", "", "k"),
    (4, "http://a.example/small", "tiny", "k"),
    (6, "http://a.example/small2", "tiny", "k"),
    (7, "http://[broken", "<p>é中\r\n\r\nWARC/1.1</p>" + "y" * 100, "k"),
    (8, "http://a.example/\ttab", "z" * 50_000, "k"),
    (None, "http://a.example/null", LONG, "k"),
    (9, "http://c.example", LONG, None),
]


def brute_pages(rows):
    first = {}
    for page, _, html, _ in rows:
        if html and len(html.encode()) >= 100 and page is not None:
            first[html] = min(first.get(html, page), page)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and page != first[html]
        yield page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None


def test_warc_query(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, urlkey string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in QUERIES["op9_warc"](spark, str(tmp_path)).collect())
    assert got == Counter(brute_pages(PAGES))


def test_index_lookup_reads_only_what_is_asked(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"http://h{i % 5}.example/p{i}", f"<p>{i}</p>" * 30) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = shared_folder(spark, "warc-test")
    index = warc.build_index(warc.write(pages, folder), folder)
    assert [p[0] for p in index.parts] == sorted(p[0] for p in index.parts)
    wanted = pages.filter("page_id % 10 = 3").union(spark.createDataFrame([(1, "http://nowhere.example/", "")], pages.schema))
    found = warc.read(index, warc.lookup(index, wanted)).collect()
    assert sorted(int(r.page) for r in found) == list(range(3, 200, 10))
    for r in found:
        assert bytes(r.payload).decode() == rows[int(r.page)][2]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.org/A/b/?z=1&a=2#part", "org,example)/a/b?a=2&z=1"),
        ("https://user@sub.example.org:8080", "org,example,sub)/"),
        ("", ""),
        (None, ""),
        ("no url", "no url"),
    ],
)
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_damaged_record_is_refused():
    data = warc.record("response", "1", "http://a.example/", b"payload", "0" * 64, None)
    assert warc.parse(data)[1] == b"payload"
    with pytest.raises(ValueError, match="not a WARC record"):
        warc.parse(data[:-3] + b"xyz")


# --- the pipeline --------------------------------------------------------------------------


def test_pipeline_stages(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    rows = {r[0]: r[1] for r in make_documents()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "redact_pii", "pack"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, fixture_dir).cache()
        if name != "pack":
            assert out.columns == docs.columns
        kept[name] = Counter(r.doc_id for r in out.collect())
        docs = out
    # documents without a letter go
    assert not {300, 301, 302, 303} & set(kept["language_id"])
    assert sum(kept["language_id"][i] for i in range(60)) == 62
    # one of each group of copies stays, every other document too
    assert [i for i in [*range(100, 140), *range(200, 208)] if i in kept["near_dedup"]] == [100, 200]
    assert all(kept["near_dedup"][i] == 1 for i in range(60))
    # documents with a benchmark window go, others stay
    assert {305, 306} & set(kept["decontaminate"]) == set()
    assert all(kept["decontaminate"][i] == 1 for i in range(60))
    assert kept["redact_pii"] == kept["decontaminate"]
    assert set(kept["pack"]) == set(kept["redact_pii"])
    assert ITEM in rows[305]


def test_pipeline_redacts(spark, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    for r in corpus_pipeline.redact_pii(spark, docs, fixture_dir).collect():
        assert base_spans(r.text) == [] or r.doc_id not in (307, 310)


def test_pipeline_run_and_empty_tables(spark, fixture_dir, empty_dir):
    out = corpus_pipeline.run(spark, fixture_dir)
    assert out.agg(F.max("length")).first()[0] <= 2048
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    for r in out.collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
