"""A z-fast trie over conversations, built in batches by joins.

Every prefix of a conversation has a 128-bit hash: the turns, each hashed with
its depth, combined by exclusive or. So prefixes are hashed in blocks of any
conversation, by associative window sums, and equal hashes stand for equal
prefixes (a hash argument: no text is compared).

The trie holds compacted nodes only: places where conversations end or part. A node's edge
spans the depths ``(low, depth]``, and its handle is the prefix at the two-fattest
number of that span, the one with most trailing zero bits. Distinct conversations
are inserted in ``BATCHES`` batches of growing size. A batch

- finds for each of its conversations the deepest node on its path by fat
  binary search: one look-up of handles per round, as many rounds as the longest
  conversation has binary digits;
- follows the edge below, found by the first turn on it, as far as it agrees (the exit);
- splits the edges where conversations exit or end;
- hangs what is new below the exits, compacted in the same way.

Counts of subtrees come from pointer jumping over compacted nodes, in as many rounds
as the binary logarithm of the deepest chain of them. At last edges are expanded:
inside an edge, one node per depth with the members of its lower end.

Copies of a conversation enter as one, with their number; ids of the members that end at a
node are hashed in order, in pieces of ``PIECE`` ids cut after a range sort. Turns are
numbered by a range sort and counts of its partitions, so a conversation may be
longer than any task.

Null turns come first, null roles and texts are empty, ties in turn are ordered by
role and text, repeated rows are repeated turns. Rows with a null id belong to no
conversation. A table without ids gives no nodes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stored

GROUP = 5  # a conversation starts as the first of its group does
HEAD = 9  # by less than so many turns
BLOCK = 4096  # turns hashed in one window
PIECE = 4096  # ids in one piece
# Of 64 hashes, those below each bound form one batch.
BATCHES = (2, 12, 64)
# A prefix: its depth and both halves of its hash. The root's is all zeros.
PREFIX = "struct<depth:int,x:bigint,y:bigint>"
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)


def prefix(depth: Column | str, x: Column | str, y: Column | str) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in (depth, x, y)]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("depth", "x", "y"), strict=True)])


def root() -> Column:
    return prefix(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))


def fattest(low: Column, high: Column) -> Column:
    """The number of ``(low, high]`` with most trailing zero bits."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return (high - F.pmod(high, F.pow(F.lit(2.0), bits).cast("int"))).cast("int")


# --- turns -------------------------------------------------------------------


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, n``: the place of every turn, with ``a, b`` (hashes of role and text) and ``size`` (bytes of the text).

    Rows are sorted by range; places follow from the places within a partition
    and the counts of the partitions before it, so no task sees all of a long conversation."""
    words = turns.select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv IS NOT NULL")
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "copy"]
    some = words.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order)
    some = some.withColumn("part", F.spark_partition_id()).select(
        "conv", "turn", "role", "text", "copy", "part",
        F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    within = Window.partitionBy("conv", "part").orderBy(*order[1:])
    some = stored(some.withColumn("n", F.row_number().over(within) - 1).drop("role", "text", "turn", "copy"), "trie-turns")
    counts = some.groupBy("conv", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).filter("before > 0").drop("c")
    placed = some.join(counts, ["conv", "part"], "left")
    return placed.select("conv", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), "a", "b", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, depth`` (from 1) of every rebuilt conversation, with ``a, b, size``."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("len"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    convs = convs.select("conv", "len", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    heads = turns.filter(F.col("n") < HEAD - 1).withColumnRenamed("conv", "base")
    lengths = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(lengths, "base", "left")
    first = heads.join(convs.select("conv", "base", "h"), "base").filter("n < h")
    start = F.least("h", F.coalesce("base_len", F.lit(0)))
    own = turns.join(convs.select("conv", "h", start.alias("start")), "conv").filter("n >= h")
    columns = ["a", "b", "size"]
    return first.select("conv", (F.col("n") + 1).cast("int").alias("depth"), *columns).unionByName(
        own.select("conv", (F.col("n") - F.col("h") + F.col("start") + 1).cast("int").alias("depth"), *columns)
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv``, ``at`` (the prefix that ends here), ``up`` (the one before), ``size`` and ``total``, the bytes so far."""
    own = turns.withColumns({
        "gx": F.xxhash64("depth", "a", "b"), "gy": F.xxhash64(F.lit(2), "b", "depth", "a"),
        "block": F.floor(F.col("depth") / BLOCK),
    })
    sums = {"x": F.bit_xor("gx"), "y": F.bit_xor("gy"), "total": F.sum("size")}
    within = Window.partitionBy("conv", "block").orderBy("depth")
    own = own.withColumns({c: s.over(within) for c, s in sums.items()})
    whole = own.filter(F.col("depth") % BLOCK == BLOCK - 1).select("conv", "block", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("total").alias("bt"))
    before = Window.partitionBy("conv").orderBy("block")
    # A full block counts for all behind it; a block has one such row for each block before.
    whole = whole.select(
        "conv", (F.col("block") + 1).alias("block"),
        *[F.expr(f"{f}({c})").over(before).alias(c) for f, c in (("bit_xor", "bx"), ("bit_xor", "by"), ("sum", "bt"))],
    )
    found = own.join(whole, ["conv", "block"], "left")
    x, y = (F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0))) for a, b in (("x", "bx"), ("y", "by")))
    return found.select(
        "conv",
        prefix("depth", x, y).alias("at"),
        prefix(F.col("depth") - 1, x.bitwiseXOR(F.col("gx")), y.bitwiseXOR(F.col("gy"))).alias("up"),
        "size",
        (F.col("total") + F.coalesce("bt", F.lit(0))).alias("total"),
    )


def hashed_ids(members: DataFrame) -> DataFrame:
    """``at, ends``: SHA-256 over the ids of each node's members, in order.

    Ids are sorted by range and joined to pieces where they lie; the last step reads
    few long pieces per node and keeps one running hash."""
    ranged = members.repartitionByRange("at", "conv").sortWithinPartitions("at", "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        node = None

        def piece() -> pa.RecordBatch:
            text = ",".join(map(str, held))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*node, held[0], text), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["depth", "x", "y", "first", "ids"],
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *own, conv in zip(*columns, strict=True):
                if held and (own != node or len(held) == PIECE):
                    yield piece()
                    held = []
                node = own
                held.append(conv)
        if held:
            yield piece()

    flat = ranged.select("at.depth", "at.x", "at.y", "conv")
    found = flat.mapInArrow(pieces, "depth int, x bigint, y bigint, first bigint, ids string")
    # Nodes of one piece are hashed where they lie; the others run over their pieces.
    found = stored(found, "trie-ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for *own, _, ids in zip(*columns, strict=True):
                if own == node:
                    running.update(b",")
                else:
                    if node is not None:
                        done.append((*node, running.hexdigest()))
                    node, running = own, hashlib.sha256()
                running.update(ids.encode())
            yield _hash_rows(done)
        if node is not None:
            yield _hash_rows([(*node, running.hexdigest())])

    ordered = found.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "first")
    out = ordered.mapInArrow(digests, "depth int, x bigint, y bigint, ends string")
    return out.select(prefix("depth", "x", "y").alias("at"), "ends")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    names = ["depth", "x", "y", "ends"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


# --- the trie ----------------------------------------------------------------
#
# A trie is a table of compacted nodes without the root: ``at``, ``low`` (where its edge
# begins), ``up`` (the node there), ``first`` and ``handle`` (prefixes on the edge) and
# ``rep``, a conversation that passes. ``paths`` holds ``rep, at, up, size, total`` of every prefix
# of the distinct conversations.


def empty_trie(paths: DataFrame) -> DataFrame:
    kinds = f"at {PREFIX}, low int, up {PREFIX}, first {PREFIX}, handle {PREFIX}, rep bigint"
    return paths.sparkSession.createDataFrame([], kinds)


def with_handles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes ``at, low, up, rep`` with the first prefix of their edge and its handle."""
    place = paths.select("rep", F.col("at.depth").alias("depth"), F.col("at").alias("found"))
    wanted = nodes.select("*", F.explode(F.array(F.col("low") + 1, fattest(F.col("low"), F.col("at.depth")))).alias("depth"))
    found = wanted.join(place, ["rep", "depth"])
    first, handle = (F.max(F.when(F.col("depth") == d, F.col("found"))) for d in (F.col("low") + 1, fattest(F.col("low"), F.col("at.depth"))))
    return found.groupBy("at", "low", "up", "rep").agg(first.alias("first"), handle.alias("handle")).select(
        "at", "low", "up", "first", "handle", "rep"
    )


def exits(batch: DataFrame, trie: DataFrame | None, paths: DataFrame, longest: int) -> DataFrame:
    """Where each of ``rep, len`` leaves the trie: ``leave`` (its last prefix in the trie), and ``edge``, the node
    on whose edge that is, null where it is a node itself."""
    if trie is None:
        return batch.select("rep", "len", root().alias("leave"), F.lit(None).cast(PREFIX).alias("edge"))
    state = batch.select(
        "rep", "len", F.lit(0).alias("lo"), F.col("len").alias("hi"), root().alias("node"),
        F.lit(None).cast(PREFIX).alias("edge"),
    )
    own = paths.select("rep", "at")
    handles = trie.select("handle", F.col("at").alias("hit"))
    for _ in range(longest.bit_length() + 1):
        # A fat binary search halves the binary digits of its range, so this many rounds end it.
        open_ = F.col("edge").isNull() & (F.col("lo") < F.col("hi"))
        f = F.when(open_, fattest(F.col("lo"), F.col("hi"))).otherwise(F.lit(0))
        asked = state.withColumn("f", f).join(own.select("rep", F.col("at.depth").alias("f"), F.col("at").alias("handle")), ["rep", "f"], "left")
        asked = asked.join(handles, "handle", "left")
        reach = F.when(F.col("hit.depth") <= F.col("len"), F.col("hit.depth")).otherwise(F.lit(-1))
        asked = asked.withColumn("reach", reach)
        there = own.select("rep", F.col("at.depth").alias("reach"), F.col("at").alias("there"))
        asked = asked.join(there, ["rep", "reach"], "left")
        miss, whole = F.col("hit").isNull(), F.col("there") == F.col("hit")
        down = F.col("f") > 0
        state = stored(asked.select(
            "rep", "len",
            F.when(down & ~miss & whole, F.col("hit.depth")).otherwise(F.col("lo")).alias("lo"),
            F.when(down & miss, F.col("f") - 1).otherwise(F.col("hi")).alias("hi"),
            F.when(down & ~miss & whole, F.col("hit")).otherwise(F.col("node")).alias("node"),
            F.when(down & ~miss & ~F.coalesce(whole, F.lit(False)), F.col("hit")).otherwise(F.col("edge")).alias("edge"),
        ), "trie-search")
        if state.filter("edge IS NULL AND lo < hi").isEmpty():
            break
    # A conversation that leaves an edge before its handle has found the node above only: its edge is known by its first turn.
    below = own.select("rep", (F.col("at.depth") - 1).alias("lo"), F.col("at").alias("first"))
    edges = trie.select("first", F.col("at").alias("child"))
    found = state.join(below, ["rep", "lo"], "left").join(edges, "first", "left")
    found = found.withColumn("edge", F.coalesce("edge", "child")).select("rep", "len", "node", "edge")
    # How far the edge agrees: prefixes equal to those of a conversation that passes it.
    spans = trie.select(F.col("at").alias("edge"), "low", F.col("rep").alias("of"))
    on = found.filter("edge IS NOT NULL").join(spans, "edge")
    steps = on.select("rep", "of", "low", F.explode(F.sequence(F.col("low") + 1, F.least("len", F.col("edge.depth")))).alias("depth"))
    mine = own.select("rep", F.col("at.depth").alias("depth"), F.col("at").alias("mine"))
    theirs = own.select(F.col("rep").alias("of"), F.col("at").alias("mine"))
    # The edge is known by its first prefix or its handle; equal prefixes are looked up by the prefix itself.
    agreed = steps.join(mine, ["rep", "depth"]).join(theirs, ["of", "mine"], "left_semi")
    agreed = agreed.groupBy("rep").agg(F.max("mine").alias("leave"))
    return stored(found.join(agreed, "rep", "left").select("rep", "len", F.coalesce("leave", "node").alias("leave"), "edge"), "trie-exits")


def insert(trie: DataFrame | None, batch: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """The trie with a batch of distinct conversations ``rep, len`` in it."""
    left = exits(batch, trie, paths, longest)
    # Nodes in the middle of edges, where conversations part or end.
    trie = empty_trie(paths) if trie is None else trie
    splits = left.filter("edge IS NOT NULL AND edge != leave").select("edge", "leave").distinct()
    cut = splits.join(trie.select(F.col("at").alias("edge"), "low", "up", "rep"), "edge")
    lower = splits.select("edge").distinct().join(trie.select(F.col("at").alias("edge"), "low", "up", "rep"), "edge")
    parts = cut.select("edge", F.col("leave").alias("at"), "low", "up", "rep").unionByName(
        lower.select("edge", F.col("edge").alias("at"), "low", "up", "rep")
    )
    above = Window.partitionBy("edge").orderBy("at")
    parts = parts.withColumn("before", F.lag("at").over(above)).select(
        "at", F.coalesce("before.depth", "low").alias("low"), F.coalesce("before", "up").alias("up"), "rep"
    )
    # What hangs below the exits: prefixes that the trie doesn't have.
    fresh = paths.join(left.filter("leave.depth < len"), "rep").filter("at.depth > leave.depth")
    fresh = stored(fresh.select("rep", "at", "up", "leave", (F.col("at.depth") == F.col("len")).alias("end")), "trie-fresh")
    grown = fresh.groupBy("at", "up").agg(F.min("rep").alias("rep"), F.max("end").alias("end"))
    forks = grown.groupBy(F.col("up").alias("at")).agg(F.count("*").alias("ways")).filter("ways > 1").select("at")
    knots = grown.filter("end").select("at", "rep").unionByName(grown.join(forks, "at", "left_semi").select("at", "rep")).distinct()
    path = Window.partitionBy("rep").orderBy("at")
    marked = fresh.join(knots.select("at", F.col("rep").alias("owner")), "at")
    marked = marked.withColumn("before", F.lag("at").over(path)).filter("rep = owner")
    new = marked.select("at", F.coalesce("before.depth", "leave.depth").alias("low"), F.coalesce("before", "leave").alias("up"), "rep")
    changed = with_handles(parts.unionByName(new), paths)
    kept = trie.join(lower.select(F.col("edge").alias("at")), "at", "left_anti")
    return stored(kept.unionByName(changed), "trie")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``at, up`` and ``n, conv, leaves, deep, bytes`` summed over subtrees (``conv``: the smallest) by pointer jumping."""
    sums = {c: F.sum(c) for c in ("n", "leaves", "deep", "bytes")} | {"conv": F.min("conv")}
    jump = F.when(F.col("up.depth") > 0, F.col("up"))
    now = stored(nodes.withColumn("jump", jump), "trie-sums")
    while not now.filter("jump IS NOT NULL").isEmpty():
        come = now.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("at")).agg(*[s.alias(f"more_{c}") for c, s in sums.items()])
        both = {c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("n", "leaves", "deep", "bytes")}
        both["conv"] = F.least("conv", "more_conv")
        ahead = now.select(F.col("at").alias("jump"), F.col("jump").alias("next"))
        step = now.join(come, "at", "left").withColumns(both)
        now = stored(step.join(ahead, "jump", "left").withColumn("jump", F.col("next")).select(*now.columns), "trie-sums")
    return now.drop("jump")


def root_node(summed: DataFrame, ends: DataFrame) -> tuple | None:
    """The root's row: one row of sums over its children and of what ends there."""
    top = summed.filter("up.depth = 0").agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "leaves", "deep", "bytes")], F.min("conv"), F.count("*")
    ).first()
    here = ends.filter("len = 0").select("n", "rep", "ends").first()
    n, leaves, deep, size, conv, children = top
    if not n and here is None:
        return None
    first = min(c for c in (conv, here and here["rep"]) if c is not None)
    return (first, 0, None, n + (here["n"] if here else 0), children, max(leaves, 1), deep - size, here["ends"] if here else EMPTY)


def build(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """The trie of the distinct conversations ``rep, len`` of ``ends``."""
    longest = ends.agg(F.max("len")).first()[0] or 0
    trie = None
    share, low = F.pmod(F.xxhash64("rep"), F.lit(BATCHES[-1])), 0
    for high in BATCHES:
        trie = insert(trie, ends.filter((share >= low) & (share < high) & (F.col("len") > 0)).select("rep", "len"), paths, longest)
        low = high
    return trie


def nodes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of all rebuilt conversations; see the module."""
    placed = stored(numbered(conversations, conv, turn, role, text), "trie-placed")
    ids = placed.select("conv").distinct()
    every = stored(prefixes(rebuilt(placed)), "trie-prefixes")
    last = every.groupBy("conv").agg(F.max(F.struct("at", "total")).alias("last"))
    members = ids.join(last, "conv", "left").select(
        "conv", F.coalesce("last.at", root()).alias("at"), F.coalesce("last.total", F.lit(0)).alias("total")
    )
    members = stored(members, "trie-members")
    ends = members.groupBy("at", "total").agg(F.min("conv").alias("rep"), F.count("*").alias("n"))
    ends = ends.join(hashed_ids(members), "at").withColumn("len", F.col("at.depth"))
    ends = stored(ends, "trie-ends")
    paths = every.withColumnRenamed("conv", "rep").join(ends.select("rep"), "rep", "left_semi")
    paths = stored(paths, "trie-paths")
    trie = build(paths, ends)

    # Own values of the nodes, then of their subtrees.
    place = paths.select("rep", "at", "total")
    start = paths.select("rep", F.col("at").alias("up"), F.col("total").alias("start"))
    forks = trie.groupBy(F.col("up").alias("at")).agg(F.count("*").alias("n_children"))
    own = trie.join(place, ["rep", "at"]).join(start, ["rep", "up"], "left").join(forks, "at", "left")
    own = own.join(ends.select("at", "n", F.col("rep").alias("conv"), F.col("ends")), "at", "left")
    zero = F.lit(0).cast("bigint")
    own = own.select(
        "at", "up", "low", "rep", "total",
        F.coalesce("n", zero).alias("n"),
        "conv",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
        (F.coalesce("n", zero) * F.col("total")).alias("deep"),
        (F.col("total") - F.coalesce("start", zero)).alias("bytes"),
        (F.col("total") - F.coalesce("start", zero)).alias("edge_bytes"),
        F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends"),
    )
    summed = stored(subtree_sums(own), "trie-nodes")

    top = root_node(summed, ends)
    if top is None:
        return conversations.sparkSession.createDataFrame([], NODE)

    # Edges expanded: every depth of (low, depth], with the bytes down to it. The root's children get its id below.
    parents = summed.select(F.col("at").alias("up"), F.col("conv").alias("up_conv"))
    steps = paths.select("rep", F.col("at.depth").alias("depth"), "size", F.col("total").alias("down"))
    edge = summed.withColumn("depth", F.explode(F.sequence(F.col("low") + 1, F.col("at.depth"))))
    edge = edge.join(steps, ["rep", "depth"]).join(parents, "up", "left")
    end = F.col("depth") == F.col("at.depth")
    above = F.col("down") - F.col("size")
    saved = F.col("deep") - F.col("n") * above - (F.col("bytes") - F.col("edge_bytes")) - (F.col("total") - above)
    inner = edge.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.when(F.col("depth") > F.col("low") + 1, F.col("conv")).when(F.col("low") == 0, F.lit(top[0])).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(end, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return inner.unionByName(conversations.sparkSession.createDataFrame([top], NODE))
