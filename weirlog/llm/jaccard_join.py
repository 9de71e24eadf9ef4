"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed word n-grams. Documents with equal sets form one class and go on as one set.
A set's tokens for splitting are its minimum hashes (place and value): two sets share a token of a place
with the probability of their similarity. Sets are split on a few sampled places; a bucket that is still
large is split again on a place sampled for its path, as often as `levels`; small buckets are compared
pair by pair. Independent first places are the repeated runs: `runs_for` gives how many of them meet a
pair at the threshold with the target recall. What stays large after the last split (many sets that are
nearly alike) is compared in blocks.

Buckets compare sketches and tell which sets hang together (a spanning forest, never all pairs). The
groups that come of it are then compared exactly, by whole n-gram sets, in blocks: that gives each set's
number of links and the exact classes. So results depend on the threshold alone; the sampled part can
only miss a group whose members never met.

Words are lower-cased runs of digits, letters and anything not ASCII. A text of fewer words than n is one
n-gram of what it has; texts without words (null ones too) have no links and are classes of their own.
Repeated rows are copies. A null doc_id is a document; a class is named by its smallest doc_id that is
not null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.operators.components import connected_components

from . import common

PLACES = 64
SALTS = np.uint64(0), np.uint64(0x9FB21C651E98DF25)
ODD = common.mixed(np.arange(1, 2 * PLACES + 1, dtype=np.uint64)) | np.uint64(1)


def runs_for(threshold: float, levels: int, recall: float) -> int:
    """First places needed: a path of `levels` splits keeps a pair with the probability threshold ** levels."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**levels))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Distinct hashes of the word n-grams, in order."""
    if not words:
        return np.empty(0, np.uint64)
    h, n = common.hashed(words), min(n, len(words))
    found = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        found = common.mixed(found * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(found)


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, other_hash, s0, s1, size, sketch): s0 and s1, 128 bits, identify the set, sketch holds its minimum hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in common.rows(batch, "text"):
                sets = [shingles(common.words_of(x), n) for x in few.column("text").to_pylist()]
                sizes = np.array([len(x) for x in sets])
                full = sizes > 0
                ids = [pa.array(np.array([common.mixed(x ^ salt).sum(dtype=np.uint64) if len(x) else 0 for x in sets], np.uint64).view(np.int64), mask=~full) for salt in SALTS]
                sketches = np.zeros((PLACES, int(full.sum())), np.uint32)
                if full.any():
                    every, starts = np.concatenate(sets), np.cumsum(sizes[full]) - sizes[full]
                    for i in range(PLACES):
                        sketches[i] = np.minimum.reduceat((every * ODD[2 * i] + ODD[2 * i + 1]) >> np.uint64(32), starts)
                rows = iter(np.ascontiguousarray(sketches.T))
                made = [next(rows).tobytes() if x else None for x in full]
                yield pa.RecordBatch.from_arrays([few.column("doc_id"), few.column("text_hash"), few.column("other_hash"), *ids, pa.array(sizes.astype(np.int64)), pa.array(made, pa.binary())], ["doc_id", "text_hash", "other_hash", "s0", "s1", "size", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(1), "text").alias("other_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, other_hash long, s0 long, s1 long, size long, sketch binary")


def path_hash(path: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    return common.mixed(common.mixed(path + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def split(frontier: DataFrame, runs: int) -> DataFrame:
    """(path, set_id) one level down. frontier: path, set_id, sketch; a first split (path 0) takes `runs` places, a later one a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").to_numpy().view(np.uint64)
            ids = batch.column("set_id").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, PLACES)
            for i in range(runs):
                place = np.full(len(path), i % PLACES) if runs > 1 else (common.mixed(path) % np.uint64(PLACES)).astype(np.int64)
                child = path_hash(path + np.uint64(i), place, sketch[np.arange(len(path)), place])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids)], ["path", "set_id"])

    return frontier.select("path", "set_id", "sketch").mapInArrow(run, "path long, set_id long")


def forest(n: int, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the given pairs of 0..n-1."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def near(sketch: np.ndarray, least: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs left x right (as places in sketch) with at least so many equal minimum hashes; rows are taken some at a time."""
    found = []
    for a in range(0, len(left), 64):
        some = left[a : a + 64]
        same = np.zeros((len(some), len(right)), np.uint8)
        for i in range(PLACES):
            same += sketch[some, i][:, None] == sketch[right, i][None]
        x, y = np.nonzero(same >= least)
        found.append((some[x], right[y]))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.empty(0, int), np.empty(0, int))


def bucket_links(buckets: DataFrame, least: int) -> DataFrame:
    """(a, b): which sets of a bucket hang together. buckets: group, path, i, j, block, set_id, sketch; block pair (i, j) of a path; small buckets share a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), own in pdf.groupby(["path", "i", "j"], sort=False):
            own = own.drop_duplicates("set_id")
            sketch, block, ids = np.frombuffer(b"".join(own["sketch"]), np.uint32).reshape(-1, PLACES), own["block"].to_numpy(), own["set_id"].to_numpy()
            x, y = near(sketch, least, np.flatnonzero(block == i), np.flatnonzero(block == j))
            out += [(ids[a], ids[b]) for a, b in forest(len(ids), x, y)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return buckets.groupBy("group").applyInPandas(run, "a long, b long")


def blocked(rows: DataFrame, key: str, total: str, block: int, batch: int) -> DataFrame:
    """Deals the rows of each key to pairs of blocks: adds block, i, j and group (what one task handles at once).

    A key of at most `block` rows is one pair (0, 0) and shares a group with others; of larger ones every
    pair of blocks is a group.
    """
    n = F.ceil(F.col(total) / block).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    alone = F.xxhash64(key, "i", "j")
    return rows.withColumn("group", F.when(F.col("blocks") > 1, alone).otherwise(F.pmod(F.xxhash64(key), F.lit(max(1, batch)))))


def groups_of(sets: DataFrame, threshold: float, recall: float, levels: int, bucket: int, slack: float) -> DataFrame:
    """(a, b): sets that may belong together, connected as found by the splits."""
    runs = runs_for(threshold, levels, recall)
    frontier = split(sets.select(F.lit(0).cast("long").alias("path"), "set_id", "sketch"), runs)
    links = []
    for level in range(1, levels + 1):
        frontier = common.materialise(frontier, "paths")
        sizes = frontier.groupBy("path").agg(F.count("*").alias("total")).where("total > 1")
        shared = common.materialise(frontier.join(sizes, "path"), "shared")
        large = F.col("total") > bucket
        n, any_large = shared.agg(F.count("*"), F.coalesce(F.max(large.cast("int")), F.lit(0))).first()
        last = level == levels or not any_large
        ready = shared if last else shared.where(~large)
        with_sketch = ready.join(sets.select("set_id", "sketch"), "set_id")
        links.append(bucket_links(blocked(with_sketch, "path", "total", bucket, n // 2000), int(slack * PLACES)))
        if last:
            break
        frontier = split(shared.where(large).join(sets.select("set_id", "sketch"), "set_id"), 1)
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return found.distinct()


def gram_sets(groups: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """groups with each set's n-grams (grams, 8 bytes each), from the text of one document that has it; a row a set.

    groups: label, total, set_id, copies, doc_id, text_hash (of that document). Rows that repeat are met before the shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    rows = groups.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in common.rows(batch, "text"):
                grams = pa.array([shingles(common.words_of(x), n).tobytes() for x in few.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(few.column(c) for c in ("label", "total", "set_id", "copies")), grams], ["label", "total", "set_id", "copies", "grams"])

    found = rows.select("label", "total", "set_id", "copies", "text").mapInArrow(run, "label long, total long, set_id long, copies long, grams binary")
    return found.groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("label", "total", "copies", "grams")))


def exact_links(sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Compares whole sets (rows of gram_sets) inside each group: rows (a, null, links) with parts of a set's number of links, and (a, b, null), a spanning forest of the links."""
    rows = blocked(sets, "label", "total", block, max(1, sets.count() // 200))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for (_, i, j), own in pdf.groupby(["label", "i", "j"], sort=False):
            ids, copies, part = own["set_id"].to_numpy(), own["copies"].to_numpy(), own["block"].to_numpy()
            grams = [np.frombuffer(x, np.uint64) for x in own["grams"]]
            size = np.array([len(x) for x in grams])
            shared = overlaps(grams)
            linked = shared >= threshold * (size[:, None] + size[None] - shared) - 1e-9
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= part[:, None] != part[None]
            sums = linked @ copies
            out += [(a, None, s) for a, s in zip(ids.tolist(), sums.tolist(), strict=True) if s]
            out += [(int(ids[a]), int(ids[b]), None) for a, b in forest(len(ids), *np.nonzero(np.triu(linked)))]
        return pd.DataFrame({k: pd.array([x[c] for x in out], "Int64") for c, k in enumerate(("a", "b", "links"))})

    return rows.groupBy("group").applyInPandas(run, "a long, b long, links long")


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections; what only one set has is left out, the rest multiplied some columns at a time."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(every, return_inverse=True, return_counts=True)
    common_to = times > 1
    place, owner = np.where(common_to, np.cumsum(common_to) - 1, -1)[place], owner
    kept = place >= 0
    place, owner = place[kept], owner[kept]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.zeros((len(sets), len(sets)))
    for a in range(0, int(common_to.sum()), columns):
        lo, hi = np.searchsorted(place, (a, a + columns))
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[lo:hi], place[lo:hi] - a] = 1
        shared += has @ has.T
    return shared


def linked(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.99, levels: int = 3, bucket: int = 1024, block: int = 256, slack: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the classes are told from: a row a document; a row a set with the root it shares with its class and its first document; the links' rows of exact_links."""
    members = common.materialise(sketched(docs, n), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "other_hash"))
    some = members.where("size > 0").groupBy("s0", "s1").agg(F.count("*").alias("copies"), first.alias("one"), F.max("sketch").alias("sketch"))
    some = some.select(F.monotonically_increasing_id().alias("set_id"), "s0", "s1", "copies", "one.doc_id", "one.text_hash", "one.other_hash", "sketch")
    sets = common.materialise(some, "sets")  # written once, so a set keeps its number
    labels = connected_components(groups_of(sets, threshold, recall, levels, bucket, slack))
    labels = common.materialise(labels.select(F.col("vertex").alias("set_id"), "label"), "labels")
    totals = labels.groupBy("label").agg(F.count("*").alias("total"))
    groups = labels.join(totals, "label").join(sets.drop("sketch"), "set_id")
    grams = common.materialise(gram_sets(groups, docs, n), "grams")
    links = common.materialise(exact_links(grams, threshold, block), "links")
    exact = connected_components(links.where("b IS NOT NULL").select("a", "b")).select(F.col("vertex").alias("set_id"), F.col("label").alias("root"))
    named = sets.drop("sketch").join(exact, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    return members, named, links


def firsts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, h0, h1): of each class the document with the smallest doc_id (none, if no member has one), then the smallest hashes of its text.

    Texts without words are classes of their own: those with an id are all there.
    """
    members, named, _ = linked(docs, **options)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "other_hash")).alias("one")
    found = named.groupBy("root").agg(one).select("one.doc_id", "one.text_hash", "one.other_hash")
    alone = members.where("size = 0 AND doc_id IS NOT NULL").select("doc_id", "text_hash", "other_hash")
    return found.union(alone).distinct().toDF("doc_id", "h0", "h1")


def classes(docs: DataFrame, **options) -> DataFrame:
    """For each document: doc_id, class_id (documents that links connect; its smallest doc_id), n_links (other documents of at least the threshold), n_copies (documents with an equal set), n_shingles. Options: those of linked."""
    members, named, links = linked(docs, **options)
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    told = named.select("s0", "s1", "set_id", "copies", "root").join(names, "root").join(counts, "set_id", "left").select("s0", "s1", "copies", "class_id", "links")
    return members.select("doc_id", "s0", "s1", "size").join(told, ["s0", "s1"], "left").select(
        "doc_id",
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.col("size").alias("n_shingles"),
    )
