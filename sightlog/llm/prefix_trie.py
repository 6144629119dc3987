"""Prefix trie of rebuilt conversations as a burst trie.

A turn is named by 128 bits of SHA-256 of its role and text. A rebuilt conversation is a string of turn ids; strings are cut into limbs of LIMB
turns, so no row holds more, and equal strings of a limb are one row with a count. All strings start in the container of their limb's head. A container
with more than CAPACITY turns (and more than one string) bursts: it becomes a node of the trie's head and its strings move on into containers by their next
turn id, until every container fits. Containers are then sorted, strings by id, and swept once: the sweep keeps a path, opens a
node for each turn beyond the prefix shared with the string before, and sums members, children, leaves and saved code points from the bottom up. What
containers give for their topmost node is added up along the burst nodes, level by level, and a limb's totals enter the limb
before it, so a conversation longer than LIMB costs one pass more for each limb.

A task holds one container, at most CAPACITY turns or one limb. Counts of bursting and of the head are combined before they are shuffled. A
conversation with many turns is numbered by ranges (places within a range and the sizes of the ranges before it), and the ids of members that end at a
node are joined in sorted pieces that one task only hashes in passing, as SHA-256 has to be taken in order.

Defined cases: rows without a conv_id belong to no conversation; turns come by turn (null first), then role, then turn id; null roles and texts are
empty; repeated rows are turns of their own; an empty table has no node; further columns are not read. ``%`` is Spark's: it
takes the sign of conv_id.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlog.llm.common import query, table
from sightlog.session import materialise

LIMB, CAPACITY = 16_384, 65_536
#: Hex digits of a turn id.
WIDTH = 32
GROUP, HEADS = 100, 6
#: Bytes of joined ids that are handed on in one piece.
PIECE = 1 << 16


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 in hex; the length of the role keeps (a, bc) and (ab, c) apart."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, WIDTH)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (c, pos, id, len) and conversations as (c, n). A conversation of any length is numbered by ranges."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_id(role, text).alias("id"), F.length(text).alias("len"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = ["turn", "role", "id", "row"]
    ranged = materialise(rows.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("c", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order)) - 1
    turns = ranged.withColumn("place", place).join(parts.select("c", "part", before.alias("before")), ["c", "part"])
    turns = turns.select("c", (F.col("before") + F.col("place")).cast("long").alias("pos"), "id", "len")
    return turns, parts.groupBy("c").agg(F.sum("count").alias("n"))


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """All conversations (c), and their rebuilt turns: the first h of the group's first conversation, then their own beyond h."""
    turns, convs = numbered(conversations)
    turns = materialise(turns)
    convs = convs.select("c", "n", (F.col("c") - F.col("c") % group).alias("base"), (F.crc32(F.col("c").cast("string")) % heads).alias("h"))
    firsts = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    known = materialise(convs.join(firsts, "base", "left").select("c", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("given")))
    shared = turns.where(F.col("pos") < heads - 1).withColumnRenamed("c", "base")
    given = known.select("c", "base", "h").join(shared, "base").where("pos < h").select("c", "pos", "id", "len")
    own = turns.join(known.select("c", "h", "given"), "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "id", "len")
    return known.select("c"), given.union(own)


def limbs(convs: DataFrame, turns: DataFrame, limb: int) -> DataFrame:
    """One row (c, limb, path, lens) per limb; a conversation without turns has one empty limb."""
    cut = turns.withColumn("limb", F.floor(F.col("pos") / limb).cast("int"))
    rows = cut.groupBy("c", "limb").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "len"))).alias("t"))
    joined = convs.join(rows, "c", "left")
    ids, lens = F.transform("t", lambda x: x["id"]), F.transform("t", lambda x: x["len"])
    empty = F.col("t").isNull()
    return joined.select(
        "c", F.coalesce("limb", F.lit(0)).alias("limb"), F.when(empty, F.lit("")).otherwise(F.array_join(ids, "")).alias("path"),
        F.when(empty, F.expr("cast(array() as array<int>)")).otherwise(lens).alias("lens"),
    )


def digest(head: Column, path: Column) -> Column:
    """Name of the node at the end of ``path`` below ``head``."""
    return F.substring(F.sha2(F.concat(head, F.lit("/"), path).cast("binary"), 256), 1, WIDTH)


NODE = "head string, key string, pkey string, plen int, top boolean, level int, conv_id long, parent long, n long, children long, leaves long, saved long, string_end string"


def sweep_container(rows: list[dict]) -> tuple[list[list], list[tuple[str, int]]]:
    """Nodes of one container, whose strings share ``at`` turns and come in order, as [level, len, parent, n, low, children, leaves, saved], the topmost first and totals
    included; and for each string its name and the place of its last node."""
    at = rows[0]["at"]
    nodes = [[at, rows[0]["last"], -1, 0, None, 0, 0, 0]]
    ends, way, before = [], [0], None
    for row in rows:
        path, depth = row["path"], len(row["path"]) // WIDTH
        if before is not None:
            same = at
            most = min(depth, len(before) // WIDTH)
            while same < most and path[same * WIDTH : (same + 1) * WIDTH] == before[same * WIDTH : (same + 1) * WIDTH]:
                same += 1
            del way[same - at + 1 :]
        for d in range(at + len(way) - 1, depth):
            nodes.append([d + 1, row["lens"][d], way[-1], 0, None, 0, 0, 0])
            way.append(len(nodes) - 1)
        end = nodes[way[-1]]
        end[3] += row["n"]
        end[4] = row["low"] if end[4] is None else min(end[4], row["low"])
        end[5], end[6], end[7] = end[5] + row["more_children"], end[6] + row["more_leaves"], end[7] + row["more_saved"]
        ends.append((row["string"], way[-1]))
        before = path
    for node in reversed(nodes):
        node[6] += node[5] == 0
        node[7] += (node[3] - 1) * node[1]
        if node[2] >= 0:
            up = nodes[node[2]]
            up[3], up[4], up[5], up[6], up[7] = up[3] + node[3], node[4] if up[4] is None else min(up[4], node[4]), up[5] + 1, up[6] + node[6], up[7] + node[7]
    return nodes, ends


def sweep(strings: DataFrame) -> DataFrame:
    """Nodes of all containers (``string_end`` null) and one row per string with the node it ends at."""
    names = [part.split()[0] for part in NODE.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[part.split()[1]] for part in NODE.split(", ")]

    def close(rows, out):
        nodes, ends = sweep_container(rows)
        first = rows[0]
        for i, (level, _, up, n, low, children, leaves, saved) in enumerate(nodes):
            out.append((first["head"], first["key"], first["pkey"], first["plen"], i == 0, level, low, nodes[up][4] if i else None, n, children, leaves, saved, None))
        for name, place in ends:
            out.append((first["head"], first["key"], None, None, False, nodes[place][0], nodes[place][4], None, None, None, None, None, name))

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(column, type=t) for column, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches):
        held, out = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["key"] != row["key"]:
                    close(held, out)
                    held = []
                    if len(out) >= 10_000:
                        yield batch_of(out)
                        out = []
                held.append(row)
        if held:
            close(held, out)
        if out:
            yield batch_of(out)

    return strings.repartition("key").sortWithinPartitions("key", "path").mapInArrow(run, NODE)


def burst(strings: DataFrame, capacity: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Strings with their container (key, at), and for each level the burst nodes with the strings that end there."""
    depth = F.length("path") / WIDTH
    below = lambda k: digest(F.col("head"), F.substring("path", 1, WIDTH * k))
    text_len = lambda k: F.get("lens", F.lit(k - 1)) if k else F.lit(0)
    closed, levels, k = [], [], 0
    still = strings
    while True:
        named = still.withColumns({"key": below(k), "at": F.lit(k), "last": text_len(k), "pkey": below(k - 1) if k else F.lit(None).cast("string"), "plen": text_len(k - 1) if k > 1 else F.lit(0)})
        sizes = named.groupBy("key").agg(F.count("*").alias("strings"), F.sum(depth - k + 1).alias("size"), *(F.min(x).alias(x) for x in ("head", "pkey", "last", "plen")))
        large = materialise(sizes.where((F.col("strings") > 1) & (F.col("size") > capacity)).drop("strings", "size"))
        if large.isEmpty():
            closed.append(named)
            break
        keys = large.select("key")
        closed.append(named.join(keys, "key", "left_anti").select(named.columns))
        moved = materialise(named.join(keys, "key", "left_semi").select(named.columns))
        ended = moved.where(depth == k)
        levels.append((large, ended))
        still = moved.where(depth > k).select(strings.columns)
        k += 1
    return reduce(DataFrame.union, closed), levels


def build(strings: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, string ends and the topmost node of each head, for the strings of one limb.

    ``strings``: head, string (its name), path, lens, n, low, more_children, more_leaves, more_saved (what hangs below its end).
    """
    containers, levels = burst(strings, capacity)
    swept = materialise(sweep(containers))
    fields = ["head", "level", "conv_id", "parent", "n", "children", "leaves", "saved"]
    ends = [swept.where("string_end IS NOT NULL").select(F.col("string_end").alias("string"), "conv_id", "level")]
    inner = swept.where("string_end IS NULL")
    nodes = [inner.where("NOT top").select(fields)]
    tops = inner.where("top")
    state = ["head", "key", "pkey", "plen", "level", "conv_id", "n", "children", "leaves", "saved"]
    waiting = tops.select(state)
    for k in range(len(levels) - 1, -1, -1):
        large, ended = levels[k]
        # what stands below this level's nodes, and strings that end at them
        here = waiting.where(F.col("level") == k + 1)
        parts = here.select(F.col("pkey").alias("key"), "conv_id", "n", F.lit(1).alias("children"), "leaves", "saved")
        parts = parts.union(ended.select("key", "low", "n", "more_children", "more_leaves", "more_saved"))
        sums = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *(F.sum(x).alias(x) for x in ("n", "children", "leaves", "saved")))
        own = F.col("saved") + (F.col("n") - 1) * F.col("last")
        heads = materialise(large.join(sums, "key").select("head", "key", "pkey", "plen", F.lit(k).alias("level"), "conv_id", "n", "children", "leaves", own.alias("saved")))
        parents = heads.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent"))
        nodes.append(here.join(parents, "pkey").select(fields))
        ends.append(ended.select("key", "string").join(heads.select("key", "conv_id", "level"), "key").select("string", "conv_id", "level"))
        waiting = waiting.where(F.col("level") <= k).union(heads.select(state))
    top = waiting.where("level = 0")
    return reduce(DataFrame.union, nodes), reduce(DataFrame.union, ends), top


def member_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined conv ids of each node (conv_id, depth) that strings end at.

    Ids are sorted by ranges and joined to pieces of at most about PIECE bytes; the pieces of a node then pass one task in order.
    """
    piece_schema = "conv_id long, depth long, first long, piece string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "depth", "first", "piece"])

    def join(batches):
        node, held, size, out = None, [], 0, []
        for batch in batches:
            for conv_id, depth, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (node != (conv_id, depth) or size >= PIECE):
                    out.append((*node, int(held[0]), ",".join(held)))
                    held, size = [], 0
                    if len(out) >= 1000:
                        yield emit(out)
                        out = []
                node = (conv_id, depth)
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            out.append((*node, int(held[0]), ",".join(held)))
        if out:
            yield emit(out)

    def hash_in_order(batches):
        node, state, out = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string()], strict=True)], names=["conv_id", "depth", "sha"])

        for batch in batches:
            for conv_id, depth, _, piece in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if node == (conv_id, depth):
                    state.update(b"," + piece.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (conv_id, depth), hashlib.sha256(piece.encode())
            if len(out) >= 10_000:
                yield flush()
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
        if out:
            yield flush()

    order = ["conv_id", "depth", "c"]
    pieces = ends.select("conv_id", F.col("depth").cast("long").alias("depth"), "c").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, piece_schema)
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hash_in_order, "conv_id long, depth long, sha string")


def trie(conversations: DataFrame, limb: int = LIMB, capacity: int = CAPACITY) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations)
    rows = materialise(limbs(convs, turns, limb))
    last = rows.agg(F.max("limb")).first()[0]
    empty_sha = F.lit(hashlib.sha256(b"").hexdigest())
    if last is None:
        nothing = F.lit(0).cast("long")
        return rows.select(F.col("c").alias("conv_id"), *(nothing.alias(x) for x in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), empty_sha.alias("ends_sha256")).limit(0)
    # names of heads, from the first limb on: a limb's head is the node that the limb before it ends at
    named = []
    for r in range(last + 1):
        here = rows.where(F.col("limb") == r)
        here = here.withColumn("head", F.lit("")) if not r else here.join(named[-1].select("c", F.col("string").alias("head")), "c")
        named.append(here.select("c", "head", digest(F.col("head"), F.col("path")).alias("string"), "path", "lens"))
        if last:
            named[-1] = materialise(named[-1])
    below, found, ends_of = None, [], []
    for r in range(last, -1, -1):
        merged = named[r].groupBy("head", "string").agg(F.first("path").alias("path"), F.first("lens").alias("lens"), F.count("*").alias("n"), F.min("c").alias("low"))
        if below is None:
            strings = merged.withColumns({x: F.lit(0).cast("long") for x in ("more_children", "more_leaves", "more_saved")})
        else:
            more = below.select(F.col("head").alias("string"), F.col("children").alias("more_children"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
            strings = merged.join(more, "string", "left").na.fill(0, ["more_children", "more_leaves", "more_saved"]).select(*merged.columns, "more_children", "more_leaves", "more_saved")
        nodes, ends, below = build(strings, capacity)
        depth = F.col("level").cast("long") + r * limb
        found.append((r, nodes.withColumn("depth", depth)))
        ends_of.append((r, ends.select("string", "conv_id", depth.alias("depth"))))
    columns = ["conv_id", "depth", "parent", "n", "children", "leaves", "saved"]
    ends_by, nodes_by = dict(ends_of), dict(found)
    all_nodes = below.withColumns({"depth": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")}).select(columns)
    finals = None
    for r in range(last + 1):
        nodes = nodes_by[r]
        if r:
            # the parent of a limb's first nodes is a node of the limb before, which may have smaller members that end there
            first = nodes.where("level = 1").drop("parent").join(ends_by[r - 1].select(F.col("string").alias("head"), F.col("conv_id").alias("parent")), "head")
            nodes = nodes.where("level > 1").select(columns).union(first.select(columns))
        all_nodes = all_nodes.union(nodes.select(columns))
        stop = named[r].select("c", "string") if r == last else named[r].select("c", "string").join(named[r + 1].select("c"), "c", "left_anti")
        at = stop.join(ends_by[r], "string").select("conv_id", "depth", "c")
        finals = at if finals is None else finals.union(at)
    shas = member_digests(finals)
    return all_nodes.join(shas, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", empty_sha).alias("ends_sha256"),
    )


#: CRC-32 comes from a table that the SQL derives bit by bit; each node's saved code points and leaves reach all prefixes of its smallest member.
OP13_SQL = """
WITH RECURSIVE bits(n, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc(c, s, i, v) AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, s, i + 1, xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON bits.k = 8 AND bits.n = xor(crc.v, CAST(ascii(substr(s, i, 1)) AS BIGINT)) & 255 WHERE i <= length(s)),
k AS (SELECT c, xor(v, 4294967295) % 6 AS h, c - c % 100 AS base FROM crc WHERE i = length(s) + 1),
o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, turn, r, length(x) AS len, substr(sha256(CAST(length(r) AS VARCHAR) || ':' || r || x), 1, 32) AS id FROM o),
t AS (SELECT c, len, id, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, id) - 1 AS pos FROM i),
b AS (SELECT k.c, t.pos, t.id, t.len FROM k JOIN t ON t.c = k.base AND t.pos < k.h
  UNION ALL SELECT k.c, 100000 + t.pos, t.id, t.len FROM k JOIN t ON t.c = k.c AND t.pos >= k.h),
p AS (SELECT c, CAST(row_number() OVER w AS BIGINT) AS d, len, string_agg(id, '') OVER w AS p FROM b WINDOW w AS (PARTITION BY c ORDER BY pos)),
q AS (SELECT c, d, len, p, left(p, 32 * (d - 1)) AS up FROM p UNION ALL SELECT c, CAST(0 AS BIGINT), 0, '', NULL FROM k),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, min(len) AS len, min(up) AS up FROM q GROUP BY p, d),
m AS (SELECT up AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
w AS (SELECT n.*, coalesce(m.n_children, 0) AS n_children, (n_convs - 1) * n.len AS saved FROM n LEFT JOIN m USING (p)),
s AS (SELECT q.p, sum(w.saved) AS saved_tokens, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM w JOIN q ON q.c = w.conv_id AND q.d <= w.d GROUP BY q.p),
e AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(p, d) AS p FROM q GROUP BY c) GROUP BY p)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN s USING (p) LEFT JOIN n u ON u.p = w.up LEFT JOIN e ON e.p = w.p
"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))
