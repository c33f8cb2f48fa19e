import math

import pytest
from pyspark.sql import functions as F

from gleaner.operators import answers as A
from gleaner.operators import evaluation as EV
from gleaner.plans import comparison as CO
from gleaner.schemas import CHUNK

HIT = "query_id string, rank int, score double, " + CHUNK


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, document_id string, rank int")


def scores(spark, ranking, relevant, k, cases):
    frame = EV.retrieval_scores(
        ranked(spark, ranking),
        spark.createDataFrame([(c,) for c in cases], "query_id string"),
        spark.createDataFrame(relevant, "query_id string, document_id string"),
        k,
    )
    return {r.query_id: r for r in frame.collect()}


def test_retrieval_scores(spark):
    got = scores(
        spark,
        [("q", "A", 1), ("q", "B", 2), ("q", "C", 3), ("late", "X", 1), ("late", "Y", 2), ("none", "A", 1)],
        [("q", "B"), ("late", "Y"), ("late", "Z")],
        1 + 2,
        ["q", "late", "none", "empty"],
    )
    assert got["q"].recall_at_k == 1 and got["q"].precision_at_k == pytest.approx(1 / 3)
    assert got["q"].reciprocal_rank == 0.5 and got["q"].ndcg_at_k == pytest.approx(1 / math.log2(3))
    assert got["late"].recall_at_k == 0.5
    assert got["late"].ndcg_at_k == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["none"].recall_at_k is None and got["none"].ndcg_at_k is None and got["none"].precision_at_k == 0
    assert got["empty"].reciprocal_rank == 0
    first = scores(spark, [("q", "A", 1), ("q", "B", 2)], [("q", "B")], 1, ["q"])["q"]
    assert first.recall_at_k == 0 and first.reciprocal_rank == 0.5 and first.ndcg_at_k == 0


def test_means_skip_null_only_where_defined(spark):
    rows = [(1.0, 0.2, 1.0, 1.0), (None, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "recall_at_k double, precision_at_k double, reciprocal_rank double, ndcg_at_k double")
    row = EV.mean_retrieval(df).first()
    assert (row.recall_at_k, row.precision_at_k, row.mrr, row.ndcg_at_k) == (1.0, 0.1, 0.5, 1.0)
    empty = EV.mean_retrieval(df.limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_document_ranking(spark):
    hits = spark.createDataFrame([("q", "B", 1), ("q", "A", 2), ("q", "B", 3), ("q", "C", 4)], "query_id string, document_id string, rank int")
    assert [r.document_id for r in EV.document_ranking(hits).orderBy("rank").collect()] == ["B", "A", "C"]


def test_generation_scores(spark):
    rows = [
        ("It costs $10", "costs $10 now", None, "factual"),
        ("I do not know", "nothing", None, "unanswerable"),
        ("I do not know", "nothing", None, "factual"),
        ("ten", " ", "ten dollars", "factual"),
    ]
    df = spark.createDataFrame(rows, "a string, c string, e string, k string")
    made = EV.generation_scores(*[F.col(c) for c in "acek"])
    got = df.select(*[c.alias(n) for n, c in made.items()]).collect()
    assert got[0].groundedness == pytest.approx(2 / 3) and got[0].answer_relevance == pytest.approx(2 / 3)
    assert got[1].faithfulness == got[1].groundedness == 1.0 and got[2].faithfulness == 0.0
    assert got[3].groundedness == 0.0 and got[3].answer_relevance == 1.0


def chunk(doc, text, title="T"):
    return ("article", doc, 0, f"article_{doc}", None, title, "S", ["T"], text, "http://x", None, None)


def test_answers_and_abstention(spark):
    hits = spark.createDataFrame([("q", 1, 1.0, *chunk("1", " Ten dollars. Or more. ")), ("q", 2, 0.5, *chunk("2", "b"))], HIT)
    asked = spark.createDataFrame([("q", "price?"), ("r", "crm?")], "query_id string, query string")
    verdicts = spark.createDataFrame([("q", True), ("r", False)], "query_id string, sufficient boolean")
    got = {r.query_id: r for r in A.answer_or_abstain(asked, hits, verdicts).collect()}
    assert got["q"].context == "[1] Title: T | Section: S | URL: http://x\nTen dollars. Or more.\n\n[2] Title: T | Section: S | URL: http://x\nb"
    assert got["q"].answer == "Ten dollars." and len(got["q"].sources) == 1
    assert got["r"].answer == A.ABSTAIN_MESSAGE and got["r"].sources == []
    prompt = spark.range(1).select(A.user_prompt(F.lit("q"), F.lit(" "))).first()[0]
    assert prompt == "Question: q\n\nContext:\nNo retrieved context."


def test_comparison_with_failures(spark):
    cases = spark.createDataFrame(
        [("a", "ten dollars", ["1"], None, "pricing"), ("b", "fails", ["2"], None, "pricing"), ("c", "what", [], None, "unanswerable")],
        "id string, question string, expected_documents array<string>, expected_answer string, category string",
    )

    def found(doc):
        def search(asked, k):
            rows = spark.createDataFrame([(doc, *chunk(doc, "ten dollars each"))], "d string, " + CHUNK).drop("d")
            return asked.withColumn("_j", F.lit(doc)).join(rows, F.col("_j") == F.col("document_id")).drop("_j", "query").withColumns(
                {"rank": F.lit(1), "score": F.lit(1.0)}
            )

        return search

    def answer(question, context):
        if question == "fails":
            raise RuntimeError("model down")
        return "ten dollars"

    timings = spark.createDataFrame([("one", "a", 9.0, 1.0, 0.0, 2.0)], "variant string, id string, end_to_end_ms double, retrieval_ms double, reranking_ms double, llm_ms double")
    results = CO.run_cases(cases, {"one": found("1"), "two": found("2")}, 5, CO.guarded(answer), timings)
    rows = {(r.variant, r.id): r for r in results.collect()}
    assert rows["one", "a"].recall_at_k == 1 and rows["two", "a"].recall_at_k == 0
    failed = rows["two", "b"]
    assert failed.error == "model down" and failed.recall_at_k == 1 and failed.reciprocal_rank == 1 and failed.answer is None
    assert failed.faithfulness == failed.groundedness == failed.context_precision == 0 and failed.context_recall is None
    assert rows["one", "a"].retrieved_documents == ["1"] and rows["one", "a"].embed_tokens == 2
    report, by_category = CO.compare(results)
    report = {r.variant: r for r in report.collect()}
    assert report["one"].error_rate == pytest.approx(1 / 3) and report["one"].case_count == 3
    assert report["one"].recall_at_k == 1 and report["one"].end_to_end_ms == 3.0 and report["two"].recall_at_k == 0
    assert {(r.variant, r.category) for r in by_category.collect()} == {(v, c) for v in ("one", "two") for c in ("pricing", "unanswerable")}
    quick = CO.run_cases(cases, {"one": found("1")}, generate=None)
    assert EV.comparison_table(EV.experiment_report(quick, "variant")).first().mrr == pytest.approx(1 / 3)
    assert EV.select_cases(cases, first=2).count() == 2 and EV.select_cases(cases, "b").count() == 1


def test_report_sink(spark, tmp_path):
    CO.write_report(spark.createDataFrame([("v", 1.0)], "variant string, mrr double"), str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).first()
    assert row.ran_at.endswith("+00:00") and row.mrr == 1.0


def test_first_sentence_stays_in_the_best_passage(spark):
    context = "[1] Title: a | Section: a | URL: u\nno end here\n\n[2] Title: b | Section: b | URL: v\nAn end. More."
    row = spark.createDataFrame([("q", context)], "q string, c string").select(A.first_sentence(F.col("q"), F.col("c"))).first()
    assert row[0] == "no end here"
