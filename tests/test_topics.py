"""Topics against a corpus: what is looked for."""

from gleaner.operators import catalog as K
from gleaner.operators import contains


def test_only_short_topics_are_looked_for_whole(spark, monkeypatch):
    texts = ["the price of the plan", "a-b c", "unpriced planning"]
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    topics = ["Price of the plan", "plan price", "A-B", "b-a", "price missing", "of the", " ", "", "!!", None]
    rows = spark.createDataFrame([(t,) for t in topics], "topic string")
    needles = []
    present = contains.present
    monkeypatch.setattr(
        contains, "present", lambda c, p: needles.extend(r.needle for r in p.select("needle").distinct().collect()) or present(c, p)
    )
    got = {r.topic: r.allowed for r in K.grounded_topics(rows, K.Catalog(rows, rows, rows, corpus)).collect()}
    assert got == {"Price of the plan": True, "plan price": True, "A-B": True, "b-a": False, "price missing": False,
                   "of the": True, " ": False, "": False, "!!": False}
    assert sorted(needles) == ["", "!!", "a-b", "b-a", "missing", "of the", "plan", "price"]


def test_words_are_looked_for_in_distinct_words(spark, monkeypatch):
    """Needles of letters and digits never cost a scan of the texts, however many there are."""
    texts = spark.createDataFrame([("unpriced plan-b 7up,\nPlan",), ("été cost",), (None,), ("plan-b again",)], "text string")
    needles = ["price", "plan", "7u", "up\n", "up", "t cost", "planb", "n-b", "t", "été", "cost\n", "lan", "", None]
    rows = spark.createDataFrame([(n,) for n in needles], "needle string")
    seen, scanned = [], contains.scanned
    monkeypatch.setattr(
        contains, "scanned",
        lambda t, n, *a: seen.append((sorted(r.text or "" for r in t.collect()), sorted(r.needle for r in n.collect()))) or scanned(t, n, *a),
    )
    monkeypatch.setattr(contains, "NEEDLES_PER_SCAN", 2)
    got = sorted(r.needle for r in contains.present(texts, rows).collect())
    assert got == sorted(["price", "plan", "7u", "up", "n-b", "t", "été", "lan"] + ["t cost"] * ("t cost" in "été cost"))
    (words, short), (whole, rest) = seen
    assert words == ["7up", "again", "b", "cost", "lan", "plan", "t", "unpriced"] and len(whole) == 4
    assert short == ["7u", "planb", "price", "up"] and rest == ["cost\n", "n-b", "t cost", "up\n", "été"]
