"""Filtered search: rows are compared with the queries that may want them, and no others."""

import numpy as np
import pandas as pd

from gleaner.operators import dense


def test_rows_meet_only_queries_of_their_label(monkeypatch):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"id": range(300), "embedding": list(rng.integers(-2, 3, (300, 4)).astype(float)), "label": [f"L{i % 6}" for i in range(300)]})
    queries = pd.DataFrame({"query_id": rows["id"], "vector": rows["embedding"], "filter_label": rows["label"]})
    cells = []
    allowed = dense._allowed
    monkeypatch.setattr(dense, "_allowed", lambda r, q, f: cells.append(len(r) * len(q)) or allowed(r, q, f))
    monkeypatch.setattr(dense, "SCORE_CELLS", 400)
    got = dense._block_top_k(iter([rows[:130], rows[130:]]), queries, "embedding", 5, ["id"], {"label": "filter_label"})
    assert sum(cells) == 300 * 300 // 6  # 300 * 300 before
    unit = dense._unit(rows["embedding"])
    for i in range(300):
        mine = [j for j in range(300) if j % 6 == i % 6]
        want = sorted(mine, key=lambda j: (-round(float(unit[j] @ unit[i]), 9), j))[:5]
        assert got[got["query_id"] == i]["id"].tolist() == want
