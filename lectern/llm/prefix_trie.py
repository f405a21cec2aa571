"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and its smallest
member owns it. Every conversation owns a suffix of its path: if it is the smallest member of a node, it is so in all
nodes below. So windows mark the owned nodes, and one group-by of all (conversation, depth) occurrences by prefix gives
the sums over whole subtrees: tokens of all occurrences less those of owned ones are what sharing saves, and a leaf is
counted once, by its owner. No tree is ever walked and no node meets its children.

Skew: a node may have a third of all conversations as members. The windows work on salted groups first, and only the
smallest member of each salted group goes on to the node's own window; the root, which all share, is summed with
map-side combine; lookups of parents join stored tables, which Spark splits at hot keys. SHA-256 is sequential, so for a node in
which many conversations end their ids are sorted and joined to chunks by many tasks, and the chunks stream through one.

Nodes are told apart by depth and 120 bits, the exclusive or of SHA-256 values of (position, turn): a running sum
that a window keeps in constant memory, however long the conversation is.

Defined results: null role or text counts as empty; turns are ordered by turn, null first, turns of one number by the digest of role and
text (repeated rows are turns of their own); rows without a conversation id belong to none and take no part; an empty
table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.scratch import stored

SALTS = 256
GROUP, MOST_BORROWED = 5, 9


def hash_of(conv_id: Column) -> Column:
    """How many turns a conversation borrows from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_BORROWED).cast("int")


@dataclass
class Turns:
    """Digests of turns in place of their texts; both are stored tables."""

    turns: DataFrame  # conv_id, pos (from 1), content, tokens
    conversations: DataFrame  # conv_id, length


def read_turns(conversations: DataFrame) -> Turns:
    """Turns numbered from 1; the text stays behind in the scan."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.octet_length(text).cast("long").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    turns = stored(turns.withColumn("pos", F.row_number().over(order)).drop("turn"), "trie-turns")
    return Turns(turns, stored(turns.groupBy("conv_id").agg(F.max("pos").alias("length")), "trie-lengths"))


def rebuilt(original: Turns) -> Turns:
    """Every conversation with its first turns taken from the first conversation of its group of five."""
    own = original.conversations.withColumn("h", hash_of(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    bases = original.conversations.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    plan = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0))))
    plan = stored(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    kept = original.turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "content", "tokens")
    heads = original.turns.filter(F.col("pos") < MOST_BORROWED).withColumnRenamed("conv_id", "base")
    taken = heads.join(plan.select("conv_id", "base", "taken"), "base").filter(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "content", "tokens")
    return Turns(stored(kept.unionByName(taken), "trie-rebuilt"), plan.select("conv_id", "length"))


def occurrences(rebuilt_turns: Turns) -> DataFrame:
    """(conv_id, depth, x, y, tokens, length): x and y name the node that the conversation's first ``depth`` turns make."""
    mark = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("content")), 256)
    bits = lambda start: F.conv(F.substring(mark, start, 15), 16, 10).cast("long")
    path = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rebuilt_turns.turns.select("conv_id", "pos", "tokens", bits(1).alias("a"), bits(16).alias("b"))
    named = marked.select("conv_id", F.col("pos").alias("depth"), "tokens", F.bit_xor("a").over(path).alias("x"), F.bit_xor("b").over(path).alias("y"))
    # The length as the conversation's last position: the same partitioning, so no join.
    return named.withColumn("length", F.max("depth").over(Window.partitionBy("conv_id")))


def owned(found: DataFrame) -> DataFrame:
    """``found`` with ``owned`` and ``leaf`` flags; one row of each node is owned.

    The smallest member of each salted group goes on to the node's own window, the others stay in their groups there
    too, so neither window has a group that grows with the node beyond a share of it.
    """
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    salted = found.withColumn("salt", salt)
    group = Window.partitionBy("depth", "x", "y", "salt")
    first = F.row_number().over(group.orderBy("conv_id")) == 1
    local = salted.select("*", first.alias("first"), F.max("length").over(group).alias("reach"))
    local = local.withColumn("salt", F.when(F.col("first"), -1).otherwise(F.col("salt")))
    node = Window.partitionBy("depth", "x", "y", "salt")
    own = F.col("first") & (F.row_number().over(node.orderBy("conv_id")) == 1)
    marked = local.select("conv_id", "depth", "x", "y", "tokens", "length", own.alias("owned"), F.max("reach").over(node).alias("reach"))
    # An owned node is a leaf if no member goes further.
    return marked.withColumn("leaf", F.col("owned") & (F.col("reach") == F.col("depth"))).drop("reach")


NODE = [("depth", pa.int32()), ("x", pa.int64()), ("y", pa.int64())]
CHUNK_IDS = 4_096


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _chunked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (depth, x, y, conv_id) that come sorted, as rows (depth, x, y, first, ids) of up to ``size`` ids of one node, joined."""
        schema = pa.schema([*NODE, ("first", pa.int64()), ("ids", pa.string())])
        now, ids = None, []
        for batch in batches:
            done = []
            for *node, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now or len(ids) == size:
                    if ids:
                        done.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = node, []
                ids.append(conv_id)
            yield _batch(done, schema)
        if ids:
            yield _batch([(*now, ids[0], ",".join(map(str, ids)))], schema)

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from chunks that come sorted by node and first id."""
    schema = pa.schema([*NODE, ("ends_sha256", pa.string())])
    now, digest = None, None
    for batch in batches:
        done = []
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield _batch(done, schema)
    if now is not None:
        yield _batch([(*now, digest.hexdigest())], schema)


def ends(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of nodes in which conversations end; the root (0, 0, 0) if some have no turns.

    Ids are sorted by node and id over all tasks, so the ids of a hot node lie in many, which join them to chunks; what one task
    digests for it are those chunks.
    """
    last = found.filter("depth = length").select("depth", "x", "y", "conv_id")
    turnless = conversations.filter("length = 0").select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv_id")
    place = ["depth", "x", "y"]
    lasts = last.unionByName(turnless).repartitionByRange(*place, "conv_id").sortWithinPartitions(*place, "conv_id")
    chunks = lasts.mapInArrow(_chunked(CHUNK_IDS), "depth int, x long, y long, first long, ids string")
    return chunks.repartition(*place).sortWithinPartitions(*place, "first").mapInArrow(_ended, "depth int, x long, y long, ends_sha256 string")


def trie(rebuilt_turns: Turns) -> DataFrame:
    """One row per node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = owned(occurrences(rebuilt_turns))
    path = Window.partitionBy("conv_id").orderBy("depth")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    shared = F.when(F.col("owned"), 0).otherwise(F.col("tokens"))
    found = found.select(
        "conv_id", "depth", "x", "y", "length", "owned",
        F.sum(shared).over(below).alias("saved"),
        F.sum(F.col("leaf").cast("long")).over(below).alias("leaves"),
        F.coalesce(F.lead("owned").over(path), F.lit(False)).alias("owns_next"),
        F.coalesce(F.lag("owned").over(path), F.lit(False)).alias("owns_parent"),
        F.lag("x").over(path).alias("parent_x"), F.lag("y").over(path).alias("parent_y"),
    )
    found = stored(found, "trie-occurrences")
    sums = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("owns_next").cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")]
    nodes = stored(found.groupBy("depth", "x", "y").agg(*sums), "trie-nodes")

    # Who owns the parent: the owner itself but for the first node that it owns, one a conversation.
    conversations = rebuilt_turns.conversations
    least = conversations.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"), F.sum((F.col("length") == 0).cast("long")).alias("turnless")).first()
    own = found.filter("owned")
    known = own.filter("owns_parent OR depth = 1").select("depth", "x", "y", F.when(F.col("depth") == 1, F.lit(least["least"])).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"))
    asked = stored(own.filter("NOT owns_parent AND depth > 1").select("depth", "x", "y", F.col("parent_x").alias("px"), F.col("parent_y").alias("py")), "trie-asked")
    owners = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    parents = known.unionByName(asked.join(owners, ["depth", "px", "py"]).select("depth", "x", "y", "parent_conv_id"))

    top = found.filter("depth = 1").agg(F.sum(F.col("owned").cast("long")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = top.select(
        F.lit(0).alias("depth"), zero.alias("x"), zero.alias("y"), F.lit(least["least"]).cast("long").alias("conv_id"), F.lit(least["n_convs"]).alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.lit(None).cast("long").alias("parent_conv_id"),
    ).filter(F.lit(least["n_convs"] > 0))
    all_nodes = nodes.join(parents, ["depth", "x", "y"]).unionByName(root)
    named = all_nodes.join(ends(found, conversations), ["depth", "x", "y"], "left")
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(read_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: CRC-32 of the decimal id, bit by bit over its bytes; the trie by joins of prefixes with their members.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT),
      lambda c, b: list_reduce(range(0, 8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h FROM ids),
parts AS (SELECT h.conv_id, 1 AS own, t.pos, r, x FROM h JOIN t USING (conv_id) WHERE t.pos > h
  UNION ALL SELECT h.conv_id, 0, t.pos, r, x FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 WHERE t.pos <= h),
seq AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, r, x FROM parts),
occ AS (SELECT conv_id, depth, strlen(x) AS bytes, sha256(string_agg(sha256(strlen(r)::VARCHAR || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM seq
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
ext AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS len FROM occ),
n AS (SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) = depth AS leaf, (count(*) - 1) * any_value(bytes) AS saved,
      sha256(coalesce(string_agg(CASE WHEN len = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM ext GROUP BY node, depth),
up AS (SELECT a.node, n.leaf, n.saved FROM n JOIN ext d ON d.node = n.node AND d.conv_id = n.conv_id JOIN ext a ON a.conv_id = d.conv_id AND a.depth <= d.depth),
s AS (SELECT node, sum(leaf::INTEGER) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN n p ON p.node = n.parent LEFT JOIN k ON k.node = n.node
"""
