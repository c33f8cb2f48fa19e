import pytest
from pyspark.sql import functions as F

from gleaner.operators import catalog as K
from gleaner.operators import evidence as EV
from gleaner.operators import questions as Q

CHUNK = "content_type string, document_id string, chunk_no int, provider string, title string, section string, text string"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        ("provider", "1", 0, "Acme Voice", "Acme Voice", "Pricing", "Acme Voice costs ten dollars. Salesforce integrations."),
        ("provider", "2", 0, "RingBell", "RingBell", "Support", "RingBell customer support is good."),
        ("provider", "3", 0, "Bell", "Bell", "Pricing", "Bell is another one."),
    ]
    return K.catalog_from_chunks(spark.createDataFrame(rows, CHUNK))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_aliases(catalog):
    got = {(r.needle, r.name) for r in catalog.aliases.collect()}
    assert {("acme voice", "Acme Voice"), ("acmevoice", "Acme Voice"), ("ring bell", "RingBell"), ("ringbell", "RingBell")} <= got


def test_match_is_whole_word_in_alias_order(spark, catalog):
    df = K.match_providers(
        asked(spark, "Is ring bell better than ACMEVOICE?", "ringbells and acme", "bell", "", "(bell)", "ringbell-bell"),
        catalog.aliases,
    )
    got = {r.query_id: r.providers for r in df.collect()}
    assert got[0] == ["Acme Voice", "RingBell", "Bell"] and got[5] == ["RingBell", "Bell"]
    assert got[1] == [] and got[2] == ["Bell"] and got[3] == [] and got[4] == ["Bell"]


def test_canonical_names(spark, catalog):
    df = asked(spark, "is RING BELL like acmevoice", "bell $1").withColumnRenamed("query", "text")
    got = {r.query_id: r.text for r in K.canonicalize(df, catalog.aliases).collect()}
    assert got == {0: "is RingBell like Acme Voice", 1: "Bell $1"}


def test_topics(spark, catalog):
    topics = spark.createDataFrame([("salesforce",), ("Salesforce support",), ("zz",), (" ",), ("fax lines",)], "topic string")
    got = {r.topic: r.allowed for r in K.grounded_topics(topics, catalog).collect()}
    assert got == {"salesforce": True, "Salesforce support": True, "zz": False, " ": False, "fax lines": False}


def test_rewrite_by_kind(spark, catalog):
    rows = [
        (0, "Can you tell me  how much is acmevoice?", "pricing"),
        (1, "please explain costs of ringbell ??", "pricing"),
        (2, " ?? ", "factual"),
        (3, "bell opinions", "review"),
    ]
    df = spark.createDataFrame(rows, "query_id long, query string, kind string")
    got = {r.query_id: r.rewritten for r in Q.rewrite(df, catalog).collect()}
    assert got == {
        0: "how much is Acme Voice pricing cost",
        1: "costs of RingBell pricing",
        2: "??",
        3: "Bell opinions reviews",
    }


def test_model_extraction_and_fallback(spark, catalog):
    answers = [
        '{"kind": "comparison", "providers": ["ringbell", "ACME VOICE", "Zoom"], "topics": ["pricing", "salesforce", "golf"]}',
        "no json",
        '{"kind": "banter", "providers": []}',
        '{"kind": "pricing"}',
        '{"kind": "pricing", "providers": [1]}',
    ]
    rows = [(i, "compare ring bell and acme voice", a) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "query_id long, query string, answer string")
    got = {r.query_id: r for r in Q.model_extraction(df, catalog).collect()}
    assert got[0].kind == "comparison" and got[0].providers == ["RingBell", "Acme Voice"]
    assert got[0].topics == ["pricing", "salesforce"] and got[0].source == "openai"
    assert [got[i].source for i in range(1, 5)] == ["heuristic", "heuristic", "openai", "heuristic"]
    assert set(got[3].providers) == {"RingBell", "Acme Voice", "Bell"} and got[3].kind == "pricing"


def test_model_rewrite(spark, catalog):
    rows = [
        (0, "ringbell or acmevoice?", "factual", '{"query": "ringbell  comparison?"}'),
        (1, "ringbell?", "factual", '{"query": "acme voice"}'),
        (2, "bell price", "pricing", "oops"),
        (3, "bell price", "factual", '{"rewritten": "bell plans"}'),
    ]
    df = spark.createDataFrame(rows, "query_id long, query string, kind string, answer string")
    got = {r.query_id: r.rewritten for r in Q.model_rewrite(df, catalog).collect()}
    assert got == {
        0: "RingBell comparison Acme Voice",
        1: "RingBell",
        2: "Bell price pricing cost",
        3: "Bell plans",
    }


def test_decomposition_has_topics_outermost(spark):
    a, b = F.array(F.lit("A"), F.lit("B")), F.array(F.lit("price"), F.lit("crm"))
    row = spark.range(1).select(Q.decomposed(a, b, F.lit("x")), Q.expanded(F.array(F.lit("x")), F.lit("pricing"))).first()
    assert row[0] == ["A price", "B price", "A crm", "B crm"]
    assert row[1] == ["x", "x plans per user"]


def test_filters(spark):
    row = spark.createDataFrame([("X", None)], "filter_provider string, filter_section string")
    merged = Q.merged_filters(row, Q.inferred_filters(F.array(F.lit("Y")), F.lit("factual"))).first()
    assert merged.filter_provider == "X" and merged.filter_content_type == "provider"
    review = Q.merged_filters(row, Q.inferred_filters(F.array(), F.lit("review"))).first()
    assert review.filter_content_type == "review"


def test_follow_up(spark):
    c = Q.follow_up_queries(F.lit(" Why? "), F.lit("Why"), F.array(F.lit("Acme")), F.array(F.lit("why"), F.lit("acme")))
    d = Q.follow_up_queries(F.lit("a"), F.lit("A"), F.array().cast("array<string>"), F.array(F.lit("A")))
    assert tuple(spark.range(1).select(c, d).first()) == (["Why?"], ["a"])


def test_verdicts(spark):
    hits = spark.createDataFrame(
        [(0, "T", "S", "ten dollars per month"), (1, "T", "S", "weather"), (3, "T", "S", "x"), (4, "T", "S", "x"), (5, "T", "S", "x")],
        "query_id long, title string, section string, text string",
    )
    rows = [
        (0, "how many dollars per month", None),
        (1, "crm price list", None),
        (2, "anything", None),
        (3, "is it", None),
        (4, "crm", '{"sufficient": true, "reason": ""}'),
        (5, "crm", "[1]"),
    ]
    asked_rows = spark.createDataFrame(rows, "query_id long, query string, answer string")
    got = {r.query_id: (r.sufficient, r.reason) for r in EV.verdicts(asked_rows, hits).collect()}
    assert got == {
        0: (True, "ok"),
        1: (False, "low_overlap"),
        2: (False, "no_hits"),
        3: (True, "ok"),
        4: (True, "ok"),
        5: (False, "low_overlap"),
    }
