"""Near-duplicate groups with min-max hashing.

Each of ``permutations`` hash permutations of a document's 3-word shingles gives two signature values, its
minimum and its maximum, so half the hash evaluations fill the signature. Bands of ``rows`` values deal
documents into buckets. Documents that share a bucket are candidates; all of a bucket belong to the
neighbourhood of its smallest document, so neighbourhoods cover every candidate pair and many buckets of one
group of copies are one neighbourhood.

Links are confirmed on the full shingle sets, as words, never on signatures. A neighbourhood of at most
``chunk`` texts is confirmed whole, in one task. A larger one is dealt into chunks; each chunk also holds the
``LEADERS`` texts that share most buckets, which ties near copies together at linear cost. Then every text
outside the neighbourhood's largest component meets, block by block, all texts that are not in its component.
So each candidate pair is either in one component or compared; no pair rows are made, and tasks return a
spanning forest of the links they confirmed.

Equal word sequences are one text, represented by their smallest doc_id. Texts without words link with
nothing and are their own component. Rows that share a doc_id are one document and one component. Rows with a
null doc_id have the component of their equal texts, null if those have none. doc_ids must be whole numbers, or
strings of such. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.blocks import U, mix, ngram_hashes, word_blocks
from lectern.plans.broadcasts import small_or_shuffled
from lectern.plans.parallelism import spread
from lectern.plans.scratch import stored

SHINGLE_WORDS = 3
PERMUTATIONS = 36
BAND_ROWS = 4
CHUNK_TEXTS = 400
LEADERS = 8
#: Shingles that one chunk is planned to hold, whatever its number of texts.
CHUNK_SHINGLES = 4_000_000
BROADCAST_ROWS = 200_000

SIGNATURE_SCHEMA = "doc_id long, sequence binary, n_shingles long, bands array<long>"


def shingle_sets(words, n: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text of a block; a shorter text's whole sequence is its one shingle."""
    grams, bounds = ngram_hashes(words.hashes, n), words.bounds
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:
            yield ngram_hashes(words.hashes[lo:hi], int(hi - lo)) ^ U(hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """(texts, 2 * permutations): minimum and maximum of every set under every permutation; sets not empty."""
    rng = np.random.Generator(np.random.PCG64(7))
    factor = rng.integers(1, 1 << 63, size=permutations, dtype=np.uint64) * U(2) + U(1)
    shift = rng.integers(1, 1 << 63, size=permutations, dtype=np.uint64)
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for k in range(permutations):
        value = flat ^ shift[k]
        value *= factor[k]
        value ^= value >> U(29)
        value *= U(0x9FB21C651E98DF25)
        out[:, 2 * k] = np.minimum.reduceat(value, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(value, at)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band. Consecutive rows come from different permutations' minima and maxima alternately."""
    texts, values = signatures.shape
    bands = values // rows
    keys = np.zeros((texts, bands), np.uint64)
    # Row j of band b is value (b + j * bands): minimum and maximum of one permutation never meet in a band.
    for j in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + signatures[:, j * bands : (j + 1) * bands])
    return mix(keys + np.arange(bands, dtype=np.uint64))


def _signature_batches(n: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_blocks(batch.column(1), fold=True):
                texts = batch.column(1).slice(words.first, len(words.counts))
                sequence = [hashlib.sha256(b" ".join((t.as_py() or "").encode().lower().split())).digest() for t in texts]
                sets = list(shingle_sets(words, n))
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    for i, keys in zip(full, band_keys(min_max([sets[i] for i in full], permutations), rows).view(np.int64), strict=True):
                        bands[i] = keys
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, len(words.counts)), pa.array(sequence, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "sequence", "n_shingles", "bands"],
                )

    return run


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node of each component of (a, b). Edges must not be null.

    Each round points every node at its first neighbour in some order, follows two such hops, and contracts the
    edges to the nodes reached; it ends when no edge is left. The order is that of the nodes at first, which
    contracts stars around their smallest node at once, and a hashed one later, so that long chains shrink by a
    constant factor each round. Neighbours meet only in aggregations, so hubs combine on the map side.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-edges")
    labels, rounds = None, 0
    while True:
        order = (lambda c: F.col(c)) if rounds == 0 else (lambda c: F.xxhash64(F.col(c), F.lit(rounds)))  # noqa: B023
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("p", order("v"))
        low = both.groupBy("u").agg(F.min_by("v", "p").alias("m"))
        low = stored(low.select("u", F.when(order("m") < order("u"), F.col("m")).otherwise(F.col("u")).alias("m")), f"{name}-low")
        hop = small_or_shuffled(low, BROADCAST_ROWS)
        one, two = hop.select(F.col("u").alias("m"), F.col("m").alias("m1")), hop.select(F.col("u").alias("m1"), F.col("m").alias("root"))
        reached = stored(low.join(one, "m").join(two, "m1").select("u", "root"), f"{name}-reached")
        to = small_or_shuffled(reached, BROADCAST_ROWS)
        over = e.join(to, "u").select("v", F.col("root").alias("ru")).join(to.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v")
        e = stored(over.filter("ru <> rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), f"{name}-edges")
        if labels is None:
            labels = reached.select(F.col("u").alias("node"), F.col("root").alias("component"))
        else:
            labels = labels.join(to.select(F.col("u").alias("component"), "root"), "component", "left")
            labels = stored(labels.select("node", F.coalesce("root", "component").alias("component")), f"{name}-labels")
        rounds += 1
        if e.isEmpty():
            break
    if rounds == 1:  # every node hopped to a smaller one
        return labels
    smallest = small_or_shuffled(stored(labels.groupBy("component").agg(F.min("node").alias("least")), f"{name}-least"), BROADCAST_ROWS)
    return stored(labels.join(smallest, "component").select("node", F.col("least").alias("component")), f"{name}-labels")


class _Forest:
    """Union-find in which the smallest index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def shingles(text: str, n: int) -> set:
    """The full shingle set, as words."""
    words = text.encode().lower().split()
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else ({tuple(words)} if words else set())


def intersections(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, from 0/1 rows over the values that at least two sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[value] > 1
    owner, value = owner[shared], value[shared]
    _, value = np.unique(value, return_inverse=True)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(value[-1]) + 1 if len(value) else 0, block):
        a, b = np.searchsorted(value, [lo, lo + block])
        rows = np.zeros((len(sets), block), np.float32)
        rows[owner[a:b], value[a:b] - lo] = 1
        both += np.rint(rows @ rows.T).astype(np.int64)
    return both


def confirm(texts: list[str], known: list[int], n: int, percent: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(root of each text, links): joins texts that are not yet in one known component.

    Counts come from 64-bit shingle hashes; every link that joins two components is then checked on the words.
    """
    sets = [s for words in word_blocks(pa.array(texts), fold=True) for s in shingle_sets(words, n)]
    sizes = np.array([len(s) for s in sets])
    both = intersections(sets)
    union = sizes[:, None] + sizes[None, :] - both
    forest, by_component, links = _Forest(len(texts)), {}, []
    for i, c in enumerate(known):
        forest.join(by_component.setdefault(c, i), i)
    for i, j in zip(*np.nonzero(np.triu((100 * both >= percent * union) & (union > 0), 1)), strict=True):
        if forest.root(i) != forest.root(j):
            a, b = shingles(texts[i], n), shingles(texts[j], n)
            if 100 * len(a & b) >= percent * len(a | b):
                forest.join(int(i), int(j))
                links.append((int(i), int(j)))
    return [forest.root(i) for i in range(len(texts))], links


def _confirm_bin(n: int, percent: int):
    """Stars of the components inside each group of a bin."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.sort_values("node").groupby("grp", sort=False):
            nodes = group["node"].tolist()
            roots, _ = confirm(group["text"].tolist(), nodes, n, percent)
            out += [(nodes[i], nodes[r]) for i, r in enumerate(roots) if nodes[i] != nodes[r]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _confirm_rest(n: int, percent: int):
    """New links only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "text"]).sort_values("node")
        nodes = rows["node"].tolist()
        _, links = confirm(rows["text"].tolist(), rows["component"].tolist(), n, percent)
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in links if nodes[i] != nodes[j]], columns=["a", "b"], dtype="int64")

    return run


def _neighbourhoods(texts: DataFrame, chunk: int) -> DataFrame:
    """(first, node, shared, parts, half): the texts that meet ``first`` in a bucket whose smallest node it is.

    ``parts`` chunks hold a neighbourhood's texts, one if it is small; ``half`` is the number of half chunks.
    """
    members = texts.filter("node IS NOT NULL").select("node", F.size("bands").alias("any"), "n_shingles", F.posexplode("bands").alias("b", "key"))
    members = members.select("node", "n_shingles", F.xxhash64("b", "key").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "first")
    buckets = small_or_shuffled(stored(buckets, "near-buckets"), BROADCAST_ROWS)
    met = members.join(buckets, "band").groupBy("first", "node").agg(F.count(F.lit(1)).alias("shared"), F.min("n_shingles").alias("n_shingles"))
    met = stored(met, "near-met")
    size = met.groupBy("first").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"))
    parts = lambda c: F.greatest(F.ceil(F.col("size") / c), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    size = size.select("first", F.when((F.col("size") <= chunk) & (F.col("weight") <= CHUNK_SHINGLES), 1).otherwise(parts(chunk - LEADERS)).alias("parts"), parts(chunk // 2).alias("half"))
    size = small_or_shuffled(stored(size, "near-sizes"), BROADCAST_ROWS)
    return stored(met.join(size, "first").select("first", "node", "shared", "parts", "half"), "near-neighbourhoods")


def _grouped(met: DataFrame) -> DataFrame:
    """(node, grp, split): the chunks of each neighbourhood; its leaders are in each chunk."""
    place = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    best = Window.partitionBy("first").orderBy(F.desc("shared"), "node")
    leaders = met.filter("parts > 1").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LEADERS).select("first", "node", "parts")
    split = (F.col("parts") > 1).alias("split")
    rows = met.select("first", "node", split, place.alias("c")).unionByName(leaders.select("first", "node", split, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c")))
    return rows.select("node", F.xxhash64("first", "c").alias("grp"), "split").distinct()


def _confirmed(docs: DataFrame, groups: DataFrame, n: int, percent: int, chunk: int) -> DataFrame:
    """(a, b): stars of what is linked inside each group. Small groups share bins; a chunk of a split one has its own."""
    groups = stored(groups, "near-groups")
    bins = max(1, groups.count() // chunk) * 4
    rows = docs.select(F.col("doc_id").alias("node"), "text").join(small_or_shuffled(groups, BROADCAST_ROWS), "node")
    binned = rows.select("node", "text", "grp", F.when(F.col("split"), F.col("grp")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(bins))).alias("bin"))
    return stored(binned.groupBy("bin").applyInPandas(_confirm_bin(n, percent), "a long, b long"), "near-stars")


def _rest_links(docs: DataFrame, met: DataFrame, component: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(a, b): links that the chunks of split neighbourhoods could not see; None if there is nothing to compare.

    Each text outside the largest component of its neighbourhood meets, in blocks, all of the neighbourhood.
    """
    large = met.filter("parts > 1").select("first", "node", "half")
    if large.isEmpty():
        return None
    owned = large.join(small_or_shuffled(component, BROADCAST_ROWS), "node", "left").select("first", "node", "half", F.coalesce("component", "node").alias("component"))
    owned = stored(owned, "near-owned")
    sizes = owned.groupBy("first", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("first").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("out_size"), F.sum("n").alias("size"))
    sizes = stored(sizes.filter("out_size > 0"), "near-main")
    if sizes.isEmpty():
        return None
    outs = F.ceil(F.col("half") * F.col("out_size") / F.col("size")).cast("int").alias("outs")
    placed = owned.join(small_or_shuffled(sizes.select("first", "main", "out_size", "size"), BROADCAST_ROWS), "first").select("first", "node", "component", "half", outs, (F.col("component") != F.col("main")).alias("out"))
    at = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    across = placed.select("first", "node", "component", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"), at("half").alias("j"))
    down = placed.filter("out").select("first", "node", "component", at("outs").alias("i"), F.explode(F.sequence(F.lit(0), F.col("half") - 1)).alias("j"))
    blocks = stored(across.unionByName(down).select("node", "component", F.xxhash64("first", "i", "j").alias("grp")).distinct(), "near-blocks")
    rows = docs.select(F.col("doc_id").alias("node"), "text").join(small_or_shuffled(blocks, BROADCAST_ROWS), "node")
    return stored(rows.groupBy("grp").applyInPandas(_confirm_rest(n, percent), "a long, b long"), "near-rest")


def components(
    documents: DataFrame, percent: int = 85, n: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, chunk: int = CHUNK_TEXTS
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(docs.mapInArrow(_signature_batches(n, permutations, rows), SIGNATURE_SCHEMA), "near-signatures")
    # Equal sequences are one node, named by their smallest doc_id.
    texts = signed.filter("n_shingles > 0").groupBy("sequence").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"))
    texts = stored(texts, "near-texts")

    met = _neighbourhoods(texts, chunk)
    component = connected(_confirmed(docs, _grouped(met), n, percent, chunk), "near-components")
    rest = _rest_links(docs, met, component, n, percent)
    if rest is not None and not rest.isEmpty():
        between = component.select("node", "component")
        of = small_or_shuffled(between, BROADCAST_ROWS)
        ends = rest.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        joined = connected(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "near-joined")
        joined = small_or_shuffled(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), BROADCAST_ROWS)
        alone = joined.select(F.col("component").alias("node"), "whole").join(of.select("node"), "node", "left_anti")
        component = component.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        component = stored(component.unionByName(alone.select("node", F.col("whole").alias("component"))), "near-result")

    known = texts.join(small_or_shuffled(component, BROADCAST_ROWS), "node", "left").select("sequence", F.coalesce("component", "node").alias("component_id"))
    known = small_or_shuffled(stored(known.filter("component_id IS NOT NULL"), "near-known"), BROADCAST_ROWS)
    joined = signed.select("doc_id", "sequence", "n_shingles").join(known, "sequence", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def drop_near_duplicates(documents: DataFrame, **how) -> DataFrame:
    """One document of each group, with all its columns: the one whose doc_id names the component.

    Rows without a doc_id stay; of rows that repeat a doc_id one stays.
    """
    found = components(documents, **how)
    gone = found.filter("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    gone = small_or_shuffled(stored(gone, "near-gone"), BROADCAST_ROWS)
    rest = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.limit(1).count():
        return rest
    return rest.filter("doc_id IS NULL").unionByName(rest.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = components(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM d, unnest(range(0, greatest(len(w) - 2, 1))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
