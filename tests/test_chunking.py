import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import chunking as C
from gleaner.schemas import DOCUMENT


def documents(spark, sections, title="Plans", doc_id="7"):
    row = (doc_id, title, "article", "Acme", "http://x/7", None, "2024-01-02", sections)
    return spark.createDataFrame([row], DOCUMENT)


def section(heading, text, path=None):
    return (heading, path or ["Plans", heading], text)


def test_short_sections_become_one_chunk_each(spark):
    docs = documents(
        spark, [section("Plans & Price", " Ten dollars. "), section("Empty", " \n "), section("Use", "Call us.")]
    )
    rows = C.structure_aware_chunks(docs).orderBy("chunk_no").collect()
    assert [r.id for r in rows] == ["article_7_plans_price_01", "article_7_use_01"]
    assert [r.text for r in rows] == ["Ten dollars.", "Call us."]
    assert [r.chunk_no for r in rows] == [0, 1]
    assert rows[0].heading_path == ["Plans", "Plans & Price"] and rows[0].source_url == "http://x/7"


def test_fixed_size_overlap_and_last_window(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = C.fixed_size_chunks(documents(spark, [section("a", text)]), 20, 5).orderBy("chunk_no").collect()
    assert [len(r.text.split()) for r in rows] == [20, 20, 20]
    assert rows[0].text.split()[-5:] == rows[1].text.split()[:5]
    assert rows[0].id == "article_7_fixed_01" and rows[0].section == "Plans"


def test_parent_child_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [section("Features", text), section("More", "a  b")])
    children = C.child_chunks(docs, 15, 5).orderBy("chunk_no").collect()
    parents = C.parent_chunks(docs).orderBy("chunk_no").collect()
    assert children[0].id == "article_7_features_child_01"
    assert {c.parent_id for c in children} == {p.id for p in parents}
    assert children[-1].text == "a  b" and parents[0].text == text and parents[0].parent_id is None


def plain_pack(units, low, high, hard, overlap):
    """The packing rules said plainly, for comparison."""
    count = lambda u: len(u.split())
    out, cur = [], []
    for u in units:
        if cur and sum(map(count, cur)) + count(u) > high:
            out.append("\n\n".join(cur))
            tail = cur[-1:]
            for v in reversed(cur[:-1]):
                if sum(map(count, tail)) + count(v) > overlap:
                    break
                tail = [v, *tail]
            cur = tail
        if count(u) > hard:
            if cur:
                out.append("\n\n".join(cur))
            cur = []
            w, step, at = u.split(), max(low - overlap, 1), 0
            while True:
                out.append(" ".join(w[at : at + low]))
                if at + low >= len(w):
                    break
                at += step
        else:
            cur = [*cur, u]
    return out + (["\n\n".join(cur)] if cur else [])


def test_packer_agrees_with_plain_rules(spark):
    rng = random.Random(3)
    cases = []
    for i in range(60):
        units = [" ".join(["w%d" % rng.randrange(99)] * rng.choice([1, 3, 8, 20, 45])) for _ in range(rng.randrange(1, 30))]
        cases.append((i, units))
    df = spark.createDataFrame(cases, "i int, units array<string>")
    sized = F.transform("units", lambda u: F.struct(u.alias("u"), T.count_tokens(u).alias("n")))
    got = dict(df.select("i", C.pack_units(sized, 12, 30, 40, 6).alias("w")).collect())
    for i, units in cases:
        assert got[i] == plain_pack(units, 12, 30, 40, 6)


def test_sentence_split_respects_limits(spark):
    text = " ".join(f"word{i}." for i in range(200))
    docs = documents(spark, [section("Long", text)])
    rows = C.structure_aware_chunks(docs, 50, 80, 120, 10).orderBy("chunk_no").collect()
    assert len(rows) > 1 and max(len(r.text.split()) for r in rows) <= 120
    assert set(re.findall(r"word\d+\.", " ".join(r.text for r in rows))) == set(text.split())


@pytest.mark.parametrize("heading,expected", [("!!!", "section"), ("A  b-C", "a_b_c"), ("x" * 60, "x" * 40)])
def test_slug(spark, heading, expected):
    assert spark.range(1).select(T.slug(F.lit(heading))).first()[0] == expected
