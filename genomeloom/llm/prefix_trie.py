"""A trie of the turns that conversations begin with: z-fast trie, filled in batches, edges expanded at the end.

Method. A conversation is the sequence of its turns; its prefix of depth d is named by a 128-bit hash
chained over the turns. The trie is compacted: a node stands where conversations part or end, with
the edge that leads to it. Its handle is the prefix whose length is the two-fattest number (the one
divisible by the highest power of two) on that edge, and nodes are hashed by their handles. The exit
node of a conversation is found by fat binary search: the two-fattest length between what surely is in
the trie and what may be is looked up; a hit moves on to that node's end, a miss below the length. So
a conversation takes as many look-ups as its length has binary digits, each a join on the handle, all conversations of a
batch at once. Then edges are cut where conversations of the batch leave them, and what is left
of the conversations is compacted among themselves and hung below. The first batch finds an empty trie, the
second, larger one what the first has built.

Sums over subtrees (members, leaves, bytes) are made by pointer jumping: after k rounds a node holds the sum
over its descendants up to 2^k edges below, so the rounds grow with the logarithm of the depth. Last, each
edge is expanded to its nodes, whose figures follow from the edge's end. Equal conversations are one
sequence with a count. Look-ups of one handle by many conversations are joins of a unique key, which
adaptive execution may split; the ends of a node are put together piece by piece and hashed as they come.

Defined cases. Null roles and texts are empty, null turns come first, equal turns are in order of their hash.
Rows without conv_id belong to no conversation and are left out. Repeated rows are turns of
their own. A table without conversations has no root. Extra columns are ignored. A conversation is a row with
16 bytes of hash for each turn, never with its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genomeloom.llm.sqltext import crc32_sql
from genomeloom.sources.shared import staged, table

#: Conversations share the beginnings of the first of each BLOCK ids; the longest such beginning has HEAD turns.
BLOCK, HEAD = 5, 8
#: Eighths of the sequences in each batch.
BATCHES = ((0, 1), (1, 8))
ROOT = bytes(16)
SEQUENCES = "conv_id long, key binary, n int, path array<binary>, above array<long>"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): hash and bytes of the text of each turn, in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.col("turn").cast("long")
    row = F.struct(turn.isNotNull().alias("dated"), turn.alias("turn"), name.alias("name"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda x: F.struct(x["name"].alias("name"), x["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first turns taken from the first conversation of the block, as many as a checksum of the id says."""
    own = turns(conversations).withColumn("_first", F.col("conv_id") - F.expr(f"pmod(conv_id, {BLOCK})"))
    heads = own.where("conv_id = _first").select("_first", F.slice("turns", 1, HEAD).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    own_part = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    # a row of h turns is enough of a head: slice() takes what there is
    both = F.concat(F.coalesce(F.slice("_head", F.lit(1), h), F.expr("slice(turns, 1, 0)")), own_part)
    return own.join(heads, "_first", "left").select("conv_id", both.alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """SEQUENCES: of each conversation (conv_id, turns) the hash of every prefix and the bytes up to it; ``key`` names the whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, above = [], []
            for row in batch.column("turns").to_pylist():
                path, sums, name, total = [], [], ROOT, 0
                for turn in row or []:
                    name, total = hashlib.blake2b(name + turn["name"], digest_size=16).digest(), total + turn["size"]
                    path.append(name)
                    sums.append(total)
                paths.append(path)
                above.append(sums)
            keys = [path[-1] if path else ROOT for path in paths]
            yield pa.record_batch([batch.column("conv_id"), pa.array(keys, pa.binary()), pa.array(list(map(len, paths)), pa.int32()), pa.array(paths, pa.list_(pa.binary())), pa.array(above, pa.list_(pa.int64()))], names=["conv_id", "key", "n", "path", "above"])

    return conversations.select("conv_id", "turns").mapInArrow(work, SEQUENCES)


def fattest(low: str, high: str) -> str:
    """SQL for the number in (low, high] that the highest power of two divides."""
    return f"({high} & shiftleft(-1, CAST(floor(log2({low} ^ {high})) AS INT)))"


def at(path: str, depth: str) -> str:
    """SQL for the prefix of that depth of a path from the root."""
    return f"CASE WHEN {depth} > 0 THEN get({path}, {depth} - 1) ELSE unhex('{ROOT.hex()}') END"


NODE = ["extent", "depth", "start", "parent", "path", "above", "below"]


def _hashed(nodes: DataFrame) -> DataFrame:
    """Nodes with the hash of their handle and of their edge's first turn."""
    return nodes.withColumn("handle", F.expr(f"CASE WHEN depth > start THEN get(path, {fattest('start', 'depth')} - start - 1) END")).withColumn("name", F.expr("CASE WHEN depth > start THEN get(path, 0) END"))


def locate(nodes: DataFrame, found: DataFrame, longest: int) -> DataFrame:
    """``found`` (sequences) with l, the depth of the deepest node above or at the end, exit (extent of the child they enter, if any) and m, the depth where they leave it."""
    named = _hashed(nodes)
    handles = named.where("handle IS NOT NULL").select("handle", F.col("depth").alias("_depth"), F.col("start").alias("_start"), F.col("extent").alias("_extent"))
    now = found.withColumn("l", F.lit(0)).withColumn("r", F.least("n", F.lit(longest)))
    for _ in range(longest.bit_length()):
        asked = now.withColumn("_f", F.expr(f"CASE WHEN l < r THEN {fattest('l', 'r')} END")).withColumn("_ask", F.expr("CASE WHEN _f IS NOT NULL THEN get(path, _f - 1) END"))
        met = asked.join(handles, F.col("_ask") == F.col("handle"), "left")
        whole = F.expr("_depth <= n AND get(path, least(_depth, n) - 1) = _extent")
        low = F.when(F.col("_f").isNull() | F.col("handle").isNull(), F.col("l")).when(whole, F.col("_depth")).otherwise(F.col("_start"))
        # a node whose handle is met but not its end is the exit node itself
        high = F.when(F.col("_f").isNull(), F.col("r")).when(F.col("handle").isNull(), F.col("_f") - 1).when(whole, F.col("r")).otherwise(F.col("_start"))
        now = met.select(*found.columns, low.alias("l"), F.greatest(low, high).alias("r"))
    entered = named.where("name IS NOT NULL").select("name", F.col("extent").alias("exit"), F.col("path").alias("_edge"))
    met = now.withColumn("_next", F.expr("CASE WHEN l < n THEN get(path, l) END")).join(entered, F.col("_next") == F.col("name"), "left")
    shared = F.expr("size(filter(zip_with(_edge, slice(path, l + 1, size(_edge)), (a, b) -> a = b), x -> x))")
    return met.select(*found.columns, "l", "exit", F.when(F.col("exit").isNull(), F.col("l")).otherwise(F.col("l") + shared).alias("m"))


def insert(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with the sequences of a batch (key, n, path, above) put in; sequences that part or end inside an edge cut it."""
    longest = nodes.agg(F.max("depth")).first()[0]
    placed = staged(locate(nodes, found, longest), "trie")
    cuts = placed.where("exit IS NOT NULL").select(F.col("exit").alias("_exit"), "m").distinct().groupBy("_exit").agg(F.collect_set("m").alias("_cuts"))
    # an edge has at most as many cuts as turns
    marks = F.expr("array_sort(array_distinct(concat(array(start, depth), coalesce(_cuts, array()))))")
    parts = nodes.join(cuts, F.col("extent") == F.col("_exit"), "left").withColumn("_marks", marks)
    piece = F.expr("explode_outer(transform(sequence(1, greatest(size(_marks) - 1, 1)), i -> struct(get(_marks, i - 1) AS lo, coalesce(get(_marks, i), get(_marks, i - 1)) AS hi)))")
    old = parts.withColumn("_p", piece).select(
        F.expr("CASE WHEN _p.hi = depth THEN extent ELSE get(path, _p.hi - start - 1) END").alias("extent"),
        F.col("_p.hi").alias("depth"),
        F.col("_p.lo").alias("start"),
        F.expr("CASE WHEN _p.lo = start THEN parent ELSE get(path, _p.lo - start - 1) END").alias("parent"),
        F.expr("slice(path, _p.lo - start + 1, _p.hi - _p.lo)").alias("path"),
        F.expr("slice(above, _p.lo - start + 1, _p.hi - _p.lo)").alias("above"),
        F.expr("CASE WHEN _p.lo = start THEN below ELSE get(above, _p.lo - start - 1) END").alias("below"),
    )
    tails = placed.where("m < n")
    steps = tails.select("key", "m", F.expr("explode(sequence(m + 1, n))").alias("d"), "path", "n").select("key", "d", F.expr("get(path, d - 1)").alias("_at"), F.expr("CASE WHEN d < n THEN get(path, d) END").alias("_next"))
    # parting or ending prefixes, counted map-side
    stops = steps.groupBy("_at").agg(F.min("_next").alias("a"), F.max("_next").alias("b"), F.max(F.col("_next").isNull()).alias("ends")).where("ends OR a <> b").select("_at")
    depths = steps.join(stops, "_at").groupBy("key").agg(F.array_sort(F.collect_list("d")).alias("_stops"))
    edge = F.expr("explode(transform(_stops, (d, i) -> struct(d AS hi, CASE WHEN i > 0 THEN get(_stops, i - 1) ELSE m END AS lo)))")
    new = tails.join(depths, "key").withColumn("_e", edge).select(
        F.expr("get(path, _e.hi - 1)").alias("extent"),
        F.struct(
            F.col("_e.hi").alias("depth"),
            F.col("_e.lo").alias("start"),
            F.expr(at("path", "_e.lo")).alias("parent"),
            F.expr("slice(path, _e.lo + 1, _e.hi - _e.lo)").alias("path"),
            F.expr("slice(above, _e.lo + 1, _e.hi - _e.lo)").alias("above"),
            F.expr("CASE WHEN _e.lo > 0 THEN get(above, _e.lo - 1) ELSE 0L END").alias("below"),
        ).alias("rest"),
    )
    return staged(old.unionByName(new.groupBy("extent").agg(F.first("rest").alias("rest")).select("extent", "rest.*")).select(*NODE), "trie")


def build(found: DataFrame) -> DataFrame:
    """NODE columns of the compacted trie of distinct sequences (key, n, path, above); ``below`` is the bytes from the root to the edge's start, ``above`` those up to each of its turns."""
    spark = found.sparkSession
    nodes = spark.createDataFrame([(ROOT, 0, 0, None, [], [], 0)], "extent binary, depth int, start int, parent binary, path array<binary>, above array<long>, below long")
    for low, high in BATCHES:
        nodes = insert(nodes, found.where(F.pmod(F.xxhash64("key"), F.lit(8)).between(low, high - 1)))
    return nodes


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """(extent, first, n, weight, edges, leaves): over each node's subtree its smallest member, members, their bytes from the root, bytes of edges, and leaves, by pointer jumping; ``depth`` bounds the edges of a way."""
    sums = {"first": F.min, "n": F.sum, "weight": F.sum, "edges": F.sum, "leaves": F.sum}
    now = nodes.select("extent", F.col("parent").alias("jump"), *sums)
    for _ in range(depth.bit_length()):
        sent = now.where("jump IS NOT NULL").groupBy("jump").agg(*(f(c).alias(f"_{c}") for c, f in sums.items())).withColumnRenamed("jump", "_to")
        ahead = now.select(F.col("extent").alias("_over"), F.col("jump").alias("_jump"))
        added = [F.least(c, f"_{c}").alias(c) if c == "first" else (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]
        now = now.join(sent, F.col("extent") == F.col("_to"), "left").join(ahead, F.col("jump") == F.col("_over"), "left").select("extent", F.col("_jump").alias("jump"), *added)
        now = staged(now, "trie")
        if now.where("jump IS NOT NULL").isEmpty():
            break
    return now.drop("jump")


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): ids ascending, comma-joined. Tasks of a range of ids join theirs first; the pieces are hashed in order."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[bytes, list[int]] = {}
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                parts.setdefault(key, []).append(conv)
            yield pa.record_batch([pa.array(list(parts), pa.binary()), pa.array([x[0] for x in parts.values()], pa.int64()), pa.array([",".join(map(str, x)) for x in parts.values()])], names=["key", "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key != last:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.record_batch([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out])], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    parts = ends.select("key", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(joined, "key binary, low long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "low").mapInArrow(hashed, "key binary, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame) -> DataFrame:
    """RESULT of every node of the trie of conversations (conv_id, turns); see the module's text."""
    every = staged(sequences(conversations), "trie")
    found = staged(every.groupBy("key").agg(F.first("n").alias("n"), F.first("path").alias("path"), F.first("above").alias("above"), F.min("conv_id").alias("first"), F.count("*").alias("k")), "trie")
    nodes = build(found.select("key", "n", "path", "above"))
    ends = found.select(F.col("key").alias("_key"), "first", "k")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "_of")
    last = F.expr("CASE WHEN depth > start THEN get(above, depth - start - 1) ELSE 0L END")
    full = nodes.join(ends, F.col("extent") == F.col("_key"), "left").join(children, F.col("extent") == F.col("_of"), "left").drop("_key", "_of")
    full = full.withColumns({"children": F.coalesce("children", F.lit(0).cast("long")), "n": F.coalesce("k", F.lit(0).cast("long")), "edges": last - F.col("below")})
    full = staged(full.withColumns({"weight": F.col("n") * last, "leaves": (F.col("children") == 0).cast("long")}), "trie")
    sums = staged(subtree_sums(full, full.agg(F.max("depth")).first()[0] or 0), "trie")
    over = sums.select(F.col("extent").alias("_parent"), F.col("first").alias("parent_first"))
    own = full.select("extent", "depth", "start", "parent", "above", "below", "children")
    met = own.join(sums, "extent").join(over, F.col("parent") == F.col("_parent"), "left").where("n > 0")
    d = F.expr("explode(sequence(if(depth = 0, 0, start + 1), depth))")
    opened = met.withColumn("d", d).withColumn("_before", F.expr("CASE WHEN d - 1 > start THEN get(above, d - start - 2) ELSE below END"))
    at_end = F.col("d") == F.col("depth")
    # bytes of the nodes of the subtree: all edges, less what stands on this edge before this node
    saved = F.col("weight") - F.col("n") * F.col("_before") - (F.col("edges") - (F.col("_before") - F.col("below")))
    rows = opened.select(
        F.when(at_end, F.col("extent")).alias("_end"),
        F.col("first").alias("conv_id"),
        F.col("d").cast("long").alias("depth"),
        F.expr("CASE WHEN d = 0 THEN NULL WHEN d - 1 > start THEN first ELSE parent_first END").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_end, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
    )
    out = rows.join(end_digests(every), F.col("_end") == F.col("key"), "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).select(*RESULT)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


#: Every prefix of every conversation as a list of digests.
ORACLE = f"""
WITH t AS (SELECT conv_id, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, strlen(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'name': name, 'size': size}} ORDER BY turn NULLS FIRST, name) AS own, conv_id - ((conv_id % {BLOCK} + {BLOCK}) % {BLOCK}) AS top, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEAD + 1} AS INT) AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns FROM c LEFT JOIN c b ON b.conv_id = c.top),
p AS (SELECT conv_id, d, len(turns) AS n, list_transform(turns[1:d], lambda x: x.name) AS key, CASE WHEN d > 0 THEN turns[d].size ELSE 0 END AS size FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
g AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends FROM p GROUP BY key, d),
k AS (SELECT a.key, count(b.key) AS children FROM g a LEFT JOIN g b ON b.d = a.d + 1 AND b.key[1:a.d] = a.key GROUP BY a.key),
u AS (SELECT unnest(list_transform(range(d + 1), lambda i: key[1:i])) AS key, children, (n - 1) * size AS saved FROM g JOIN k USING (key)),
s AS (SELECT key, count(*) FILTER (WHERE children = 0) AS leaves, CAST(sum(saved) AS BIGINT) AS saved FROM u GROUP BY key)
SELECT g.conv_id, g.d AS depth, o.conv_id AS parent_conv_id, g.n AS n_convs, children AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN k USING (key) JOIN s USING (key) LEFT JOIN g o ON g.d > 0 AND o.d = g.d - 1 AND o.key = g.key[1:g.d - 1]
"""
