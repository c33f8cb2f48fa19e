"""Queries and their SQL on small tables that the given ones do not cover."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


def both(spark, folder, name: str, **tables: pd.DataFrame) -> tuple[list, list]:
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.to_parquet(f"{folder}/{table}.parquet", index=False)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(entry.oracle_sql()[name]).df()[got.columns]
    return [sorted(map(str, map(tuple, frame.astype(str).to_numpy()))) for frame in (got.toPandas(), want)]


@pytest.mark.parametrize("name", ["page_blocks", "pages_clean", "page_sections", "page_chunks"])
def test_references_cut_short(spark, tmp_path, name):
    """Titles that end within a character reference: it counts without its semicolon."""
    ends = ["x&amp;", "x&amp", "x&am", "x&", "x&quot", "x&quo", "x&copy", "x&lt;y", "x&amp;lt;y", "x&amp&amp"]
    html = [
        f'<html><head><title>t</title></head><body><nav>n</nav><div class="ad">ad</div><article><h1>{e}</h1>'
        f"<p><b>{e} w<br></article><footer>&copy; f</footer></body></html>"
        for e in ends
    ]
    pages = pd.DataFrame({"page_id": range(len(ends)), "url": [f"http://u/{i}" for i in range(len(ends))], "html": html})
    got, want = both(spark, tmp_path, name, pages=pages)
    assert got == want


def test_tree_of_many_summaries(spark, tmp_path):
    """A level of more than 100 nodes: their ids have two and three digits."""
    lines = "\n".join(f"word{i % 7} number{i % 11} line{i}" for i in range(405))
    documents = pd.DataFrame({"doc_id": [7, 8], "text": [lines, "short"], "lang": ["en", "fr"], "source": ["s", "s"], "n_chars": [len(lines), 5]})
    got, want = both(spark, tmp_path, "tree_incremental", documents=documents)
    assert got == want
