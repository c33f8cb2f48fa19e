"""Keyed k-means and summary trees in SQL, for the queries over them."""

from __future__ import annotations

from bindings import base as B
from gleaner.operators import kmeans as KM

ONE, UNIT = f"{KM.ONE:.1f}", str(KM.UNIT)


def clusters(p: str, points: str, k: str, rounds: int = KM.MAX_ROUNDS, seed: int = 0) -> str:
    """CTEs from ``points(g, key, name, vector)`` to ``{p}_clusters(g, key, cluster)``; ``k`` is an expression in ``n``."""
    return f"""
{p}_units AS MATERIALIZED (
  SELECT g, key, CAST('0x' || substr(md5('{seed}:' || name), 1, 8) AS BIGINT) AS h,
         list_transform(v, lambda x: CAST(floor((CASE WHEN l > 0 THEN x / l ELSE 0 END) * {UNIT} + 0.5) AS DOUBLE)) AS q
  FROM (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM (SELECT g, key, name, CAST(vector AS DOUBLE[]) AS v FROM {points}))
),
{p}_sized AS MATERIALIZED (
  SELECT * FROM (SELECT *, least(n, {k}) AS k FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {p}_units)) WHERE k >= 1
),
{p}_race AS (
  SELECT g, key, q, k, h AS x, -{ONE} AS near, CASE WHEN row_number() OVER (PARTITION BY g ORDER BY h, key) = 1 THEN 0 END AS place, 1 AS have
  FROM {p}_sized
  UNION ALL
  SELECT g, key, q, k, x, near, CASE WHEN r <= least(have, k - have) THEN r - 1 + have END, 2 * have
  FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN {ONE} - near >= {ONE} * 1e-6
        THEN -ln((x + 0.5) / {KM.RANGE}) / pow(({ONE} - near) / {ONE}, 2) ELSE CAST('infinity' AS DOUBLE) END, key) AS r
    FROM (
      SELECT a.g, a.key, any_value(a.q) AS q, any_value(a.k) AS k, (any_value(a.x) * {KM.STEP} + {KM.SHIFT}) % {KM.RANGE} AS x,
             greatest(any_value(a.near), max(list_dot_product(a.q, b.q))) AS near, any_value(a.have) AS have
      FROM {p}_race a LEFT JOIN {p}_race b ON b.g = a.g AND b.place IS NOT NULL WHERE a.have < a.k GROUP BY a.g, a.key
    )
  )
),
{p}_start AS MATERIALIZED (SELECT g, place AS c, q AS v FROM {p}_race WHERE place IS NOT NULL),
{p}_step AS (
  SELECT 0 AS turn, g, key, q, k, 0 AS c, CAST(0 AS DOUBLE) AS dot, true AS moved FROM {p}_sized
  UNION ALL
  (
    WITH members AS (SELECT g, c, unnest(range(1, len(q) + 1)) AS pos, unnest(q) AS x FROM {p}_step WHERE turn > 0),
    means AS (SELECT g, c, list(m ORDER BY pos) AS m FROM (SELECT g, c, pos, floor(sum(x) / count(*) + 0.5) AS m FROM members GROUP BY ALL) GROUP BY ALL),
    held AS (SELECT g, c, list_transform(m, lambda x: CASE WHEN l > 0 THEN floor(x / l * {UNIT} + 0.5) ELSE 0.0 END) AS v
             FROM (SELECT *, sqrt(list_dot_product(m, m)) AS l FROM means)),
    every AS (SELECT DISTINCT g, unnest(range(0, k)) AS c FROM {p}_step WHERE turn > 0),
    lost AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY c) AS r FROM every ANTI JOIN held USING (g, c)),
    far AS (SELECT g, q AS v, row_number() OVER (PARTITION BY g ORDER BY dot, key) AS r FROM {p}_step WHERE turn > 0),
    centers AS (
      SELECT g, c, v FROM held UNION ALL SELECT g, c, v FROM lost JOIN far USING (g, r)
      UNION ALL SELECT g, c, v FROM {p}_start WHERE (SELECT max(turn) FROM {p}_step) = 0
    ),
    near AS (
      SELECT s.turn + 1 AS turn, s.g, s.key, s.q, s.k, s.c AS old, z.c, list_dot_product(s.q, z.v) AS dot
      FROM {p}_step s JOIN centers z USING (g) WHERE s.moved AND s.turn < {rounds}
    ),
    best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY g, key ORDER BY dot DESC, c) = 1)
    SELECT turn, g, key, q, k, c, dot, bool_or(c <> old) OVER (PARTITION BY g) AS moved FROM best
  )
),
{p}_last AS MATERIALIZED (SELECT g, key, c FROM {p}_step QUALIFY turn = max(turn) OVER (PARTITION BY g)),
{p}_clusters AS MATERIALIZED (SELECT g, key, CAST(dense_rank() OVER (PARTITION BY g ORDER BY c) - 1 AS INT) AS cluster FROM {p}_last)"""


def embedded(name: str, nodes: str, text: str, dims: int) -> str:
    """``{name}(id, vector)``: the hashed vectors of ``text`` over ``nodes(id, ...)``."""
    return f"""
{name}_counts AS (
  SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {dims} AS bucket, count(*) AS c
  FROM (SELECT id, unnest({B.TOKENS.format(text)}) AS t FROM {nodes}) GROUP BY ALL
),
{name}_weights AS (SELECT id, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS w FROM {name}_counts),
{name} AS MATERIALIZED (
  SELECT id, list(coalesce(w, 0) ORDER BY bucket) AS vector
  FROM (SELECT id, unnest(range(0, {dims})) AS bucket FROM {nodes}) LEFT JOIN {name}_weights USING (id, bucket) GROUP BY id
)"""


CHILD = "trim(trim(section || ': ' || trim(text, E' \\n\\t'), ': '), E' \\n\\t')"
NODE_TEXT = "'Title: ' || title || chr(10) || 'Provider: ' || provider || chr(10) || 'Section: ' || section || chr(10) || chr(10) || text"
WANTED = "least(greatest(2, least(n, CAST(ceil(n / 4.0) AS BIGINT))), n - 1)"


def tree(p: str, leaves: str, dims: int, levels: int = 3) -> str:
    """CTEs from ``leaves(document_id, ord, id, section, title, provider, text, content_type)`` to ``{p}_nodes``, with ``level``,
    ``vector``, ``parent_id`` and ``children``."""
    columns = "document_id, ord, id, section, title, provider, text, content_type"
    parts = [f"\n{p}_n0 AS MATERIALIZED (SELECT {columns}, CAST([] AS VARCHAR[]) AS children FROM {leaves})"]
    for level in range(1, levels + 1):
        q, before = f"{p}{level}", f"{p}_n{level - 1}"
        parts += [
            embedded(f"{q}_e", before, NODE_TEXT, dims),
            f"\n{q}_points AS MATERIALIZED (SELECT document_id AS g, {{'ord': ord, 'id': id}} AS key, id AS name, vector FROM {before} JOIN {q}_e USING (id))",
            clusters(q, f"{q}_points", WANTED),
            f"""
{q}_of AS MATERIALIZED (
  SELECT n.*, 'raptor_' || document_id || '_l{level}_' || {B.two_digits("cluster")} AS parent, cluster FROM {before} n JOIN {q}_clusters c ON c.g = n.document_id AND c.key.id = n.id
),
{p}_n{level} AS MATERIALIZED (
  SELECT document_id, CAST(cluster AS BIGINT) AS ord, parent AS id, 'Summary' AS section, any_value(title) AS title, any_value(provider) AS provider,
         string_agg({CHILD}, ' ' ORDER BY ord, id) AS text, any_value(content_type) AS content_type, list(id ORDER BY ord, id) AS children
  FROM {q}_of GROUP BY document_id, cluster, parent
)""",
        ]
    parts.append(embedded(f"{p}{levels + 1}_e", f"{p}_n{levels}", NODE_TEXT, dims))
    each = [
        f"SELECT n.*, {level} AS level, e.vector" + (f", o.parent AS parent_id FROM {p}_n{level} n JOIN {p}{level + 1}_e e USING (id) LEFT JOIN {p}{level + 1}_of o ON o.id = n.id"
        if level < levels else f", NULL AS parent_id FROM {p}_n{level} n JOIN {p}{level + 1}_e e USING (id)")
        for level in range(levels + 1)
    ]
    parts.append(f"\n{p}_nodes AS MATERIALIZED ({' UNION ALL '.join(each)})")
    return ",".join(parts)
