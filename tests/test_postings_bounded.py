"""Queries that search the lexical index aggregate what is asked for, never a row per chunk and term."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DOCUMENTS, WORDS, SHARED = 60, 400, 20


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents of many distinct words; every other question repeats words of one of them."""
    path = tmp_path_factory.mktemp("words")
    texts = [" ".join(f"w{i * WORDS + j if j >= SHARED else j}" for j in range(WORDS)) + "." for i in range(DOCUMENTS)]
    langs, sources = ("en", "fr", "de"), ("src0", "src1")
    documents = pd.DataFrame({"doc_id": range(DOCUMENTS + 2), "text": [*texts, "", None], "n_chars": 0})
    documents["lang"] = [langs[i % 3] for i in documents["doc_id"]]
    documents["source"] = [sources[i % 2] for i in documents["doc_id"]]
    asked = [" ".join(texts[i].split()[50 + i : 58 + i]) if i % 2 == 0 else f"w{i} w3 unknown" for i in range(8)]
    documents.to_parquet(path / "documents.parquet", index=False)
    pd.DataFrame({"item_id": range(8), "text": asked}).to_parquet(path / "benchmark.parquet", index=False)
    return path


def executions(spark) -> list[int]:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).executionId() for i in range(found.size())]


def most_aggregated(spark, ids: set[int]) -> int:
    """Rows of one aggregation of these executions, over all its tasks, at most."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for i in ids:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(n) for n in range(nodes.size())):
            metrics = node.metrics() if "Aggregate" in node.name() else None
            for metric in (metrics.apply(m) for m in range(metrics.size() if metrics else 0)):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def normal(frame: pd.DataFrame) -> list[str]:
    shown = frame[sorted(frame.columns)].map(lambda v: f"{v:.6f}" if isinstance(v, float) else str(v))
    return sorted(map(str, map(tuple, shown.to_numpy())))


@pytest.mark.parametrize(
    "name",
    ["pair_rerank", "report_round_trip", "rrf_hybrid", "eval_compare", "eval_failures", "evidence", "lexical_rerank"],
)
def test_postings_are_not_aggregated(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    before = set(executions(spark))
    got = entry.queries()[name](spark, str(folder)).toPandas()
    assert len(got) and normal(got) == normal(con.execute(entry.oracle_sql()[name]).df())
    assert 0 < most_aggregated(spark, set(executions(spark)) - before) < DOCUMENTS * WORDS / 10
