"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then the rotation that brings the sample closest
to the corners of a cube) turns a vector into a binary code. The code is cut into substrings of 8 bits,
each with a table of its own. By the pigeonhole principle, two codes within radius r = m * s + a of each
other (m substrings) differ in at most s bits in one of the first a + 1 substrings or in at most s - 1 in
one of the others; so the tables' entries within these distances of a query's substrings hold every code
within r. Those codes are checked in full and the vectors of the ones that pass are ranked by Euclidean
distance in double precision.

The index covers all rows, in blocks of bounded size; a query meets every block and brings home its k best
of each, so identical or crowded vectors fill a block's answer but never a task. A first radius is set before
the search: `probes` vectors are compared with all rows exactly, and the radius is the least that covers
the wanted share of their true neighbours.

It only makes the first search short. A bit that differs puts a corner's wall between two vectors, so their
squared distance is at least the sum of the query's squared projections on the differing axes. Hence a query's
k-th distance gives the radius beyond which nothing nearer can lie. A query whose first radius is less is
searched again with its own, to all rows if need be (always if it has fewer than k): the answer is exact.

Vectors that are null, zero, hold null or non-finite components, have no id or another length than most of
the sample take no part. A row with the query's id is the query's own. Rows with equal id and vector count
once. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OUT = "query_id long, vec_id long, score double"

#: So many bits a substring and the tables' entries are so many that all codes are compared instead.
WIDE = 2


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col("vector")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)


def matrix(column: pa.Array | pd.Series, size: int) -> np.ndarray:
    return np.array([np.asarray(x) for x in column], np.float64).reshape(-1, size)


def learned(sample: np.ndarray, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation of the codes."""
    mean = sample.mean(0)
    centred = sample - mean
    axes = np.linalg.eigh(np.cov(centred.T) if len(sample) > 1 else np.eye(sample.shape[1]))[1] if sample.shape[1] > 1 else np.eye(1)
    turned = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(sample.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(turned @ rotation > 0, 1.0, -1.0).T @ turned)
        rotation = v.T @ u.T
    return mean, axes @ rotation


def codes(vectors: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Substrings of 8 bits, a row a vector."""
    return np.packbits((vectors - mean) @ rotation > 0, axis=1)


@dataclass(frozen=True)
class Tables:
    """The codes of a block and a table a substring: rows in the order of their value there, and where each value starts."""

    codes: np.ndarray
    order: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray) -> Tables:
        order = np.argsort(codes, axis=0, kind="stable")
        return cls(codes, order, np.array([np.searchsorted(codes[o, i], np.arange(257)) for i, o in enumerate(order.T)]))

    def entries(self, i: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all these values in table i, and how many each value has."""
        first, n = self.starts[i, values], self.starts[i, values + 1] - self.starts[i, values]
        return self.order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), i], n


def probed(query: np.ndarray, index: Tables, radius: int) -> np.ndarray:
    """Which codes of the index (columns) are within the radius of each query (rows), by the substrings' tables."""
    size, m = index.codes.shape
    s, a = divmod(radius, m)
    met = np.zeros((len(query), size), bool)
    for i in range(m):
        reach = s if i <= a else s - 1
        if reach >= 0:
            asking, values = np.nonzero(np.bitwise_count(query[:, i][:, None] ^ np.arange(256, dtype=np.uint8)) <= reach)
            found, n = index.entries(i, values)
            met[np.repeat(asking, n), found] = True
    rows, cols = np.nonzero(met)
    distance = np.zeros(len(rows), np.uint16)
    for i in range(m):
        distance += np.bitwise_count(query[rows, i] ^ index.codes[cols, i])
    met[rows, cols] = distance <= radius
    return met


def best(query_ids: np.ndarray, query: np.ndarray, ids: np.ndarray, index: np.ndarray, met: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k nearest of what it met (all, if met is None)."""
    for i, own in enumerate(query_ids):
        at = np.flatnonzero((met[i] if met is not None else True) & (ids != own))
        if len(at):
            score = np.sqrt(np.square(index[at] - query[i]).sum(1))
            order = np.lexsort((ids[at], score))[:k]
            yield own, ids[at][order], score[order]


def closest(query_ids: np.ndarray, query: np.ndarray, ids: np.ndarray, index: np.ndarray, mean: np.ndarray, k: int, within: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k nearest of all, of those within its distance at least; products of matrices choose what is compared in double precision."""
    a, b = query - mean, index - mean
    norms = np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None]
    far, slack = norms - 2.0 * (a @ b.T), 1e-9 * norms
    for i, own in enumerate(query_ids):
        other = np.flatnonzero(ids != own)
        most, least = far[i, other] + slack[i, other], far[i, other] - slack[i, other]
        bound = min(within[i] ** 2 * (1 + 1e-9), np.partition(most, k - 1)[k - 1] if len(most) > k else np.inf)
        at = other[~(least > bound)]
        if len(at):
            score = np.sqrt(np.square(index[at] - query[i]).sum(1))
            order = np.lexsort((ids[at], score))[:k]
            yield own, ids[at][order], score[order]


def reach(query: np.ndarray, mean: np.ndarray, rotation: np.ndarray, within: np.ndarray) -> np.ndarray:
    """For each query the radius that holds the code of every vector within its distance (all bits, if that is infinite)."""
    centred = query - mean
    error = 1e-9 * (np.sqrt(np.square(centred).sum(1)) + np.where(np.isfinite(within), within, 0.0) + np.sqrt(np.square(mean).sum()))
    walls = np.sort(np.square(np.maximum(np.abs(centred @ rotation) - error[:, None], 0.0)), axis=1)
    return (~(np.cumsum(walls, axis=1) > (within**2 * (1 + 1e-9))[:, None])).sum(1)


def unsettled(asked: DataFrame, found: DataFrame, k: int, size: int, model: tuple, radius: int) -> DataFrame:
    """(vec_id, vector, within): the queries whose radius leaves out what may be nearer than their k-th; within is its distance, infinite if there are fewer."""
    last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("last"))
    held = asked.join(last, asked["vec_id"] == last["query_id"], "left").select("vec_id", "vector", F.when(F.col("n") >= k, F.col("last")).otherwise(F.lit(float("inf"))).alias("within"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            yield own[reach(matrix(own["vector"], size), *model, own["within"].to_numpy()) > radius]

    return held.mapInPandas(run, "vec_id long, vector array<double>, within double")


def searched(queries: DataFrame, rows: DataFrame, k: int, size: int, model: tuple | None, radius: int | None, blocks: tuple[int, int]) -> DataFrame:
    """The k best of each pair of blocks; without a model every vector is compared, without a radius (queries with `within`) each query has its own."""
    numbered = [df.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")) for df, n in zip((queries, rows), blocks, strict=True)]
    own = [F.col("within")] if radius is None else []
    left = numbered[0].select(F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("j"), "vec_id", "vector", *own)
    right = numbered[1].select(F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("i"), F.col("block").alias("j"), "vec_id", "vector")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            b = b.drop_duplicates("vec_id") if b["vec_id"].is_unique else b[~pd.DataFrame({"i": b["vec_id"], "v": [np.asarray(x).tobytes() for x in b["vector"]]}).duplicated().to_numpy()]
            query, index, ids = matrix(a["vector"], size), matrix(b["vector"], size), b["vec_id"].to_numpy()
            of_index = Tables.of(codes(index, *model)) if model else None
            asking, within, radii = a["vec_id"].to_numpy(), None, None
            if radius is None:
                within = a["within"].to_numpy()
                radii = reach(query, *model, within)
                order = np.argsort(radii, kind="stable")
                asking, query, within, radii = asking[order], query[order], within[order], radii[order]
            for lo in range(0, len(a), 256):
                some, who = query[lo : lo + 256], asking[lo : lo + 256]
                own_radius = radius if radii is None else int(radii[lo : lo + 256].max())
                if radii is not None and own_radius >= WIDE * of_index.codes.shape[1]:
                    nearest_few = closest(who, some, ids, index, model[0], k, within[lo : lo + 256])
                else:
                    nearest_few = best(who, some, ids, index, probed(codes(some, *model), of_index, own_radius) if model else None, k)
                for query_id, found, score in nearest_few:
                    out += [(query_id, x, y) for x, y in zip(found.tolist(), score.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, OUT)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks; repeated query rows count once."""
    nearest = F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k)
    top = found.groupBy("query_id").agg(nearest.alias("found")).select("query_id", F.posexplode("found").alias("at", "one"))
    return top.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = 10_000, probes: int = 64, cover: float = 0.98, index_block: int = 16_384, query_block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest vectors. Both tables: vec_id, embedding."""
    rows, asked = usable(vectors), usable(queries).distinct()
    drawn = rows.select("vec_id", "vector", F.xxhash64("vec_id", F.lit(3)).alias("draw"))
    n = rows.count()
    spark = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, 1.3 * sample / n)
    some = drawn.where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("draw", "vec_id").limit(sample).collect()  # bounded by `sample`
    size = int(np.bincount([len(r.vector) for r in some]).argmax())
    rows, asked = (x.where(F.size("vector") == size) for x in (rows, asked))
    some = [r for r in some if len(r.vector) == size]
    model = learned(np.array([r.vector for r in some]))
    trial = spark.createDataFrame([(r.vec_id, r.vector) for r in some[:probes]], "vec_id long, vector array<double>")
    index_blocks = -(-n // index_block)
    truth = ranked(searched(trial, rows, k, size, None, 0, (1, index_blocks)), k).join(rows.select("vec_id", F.col("vector").alias("other")), "vec_id")
    truth = truth.join(trial.select(F.col("vec_id").alias("query_id"), "vector"), "query_id").select("vector", "other").collect()  # probes * k rows
    radius = size
    if truth:
        a, b = (codes(np.array([r[c] for r in truth]), *model) for c in ("vector", "other"))
        radius = int(np.quantile(np.bitwise_count(a ^ b).sum(1), cover, method="higher"))
    asked = common.materialise(asked, "asked")
    first = common.materialise(searched(asked, rows, k, size, model, radius, (-(-asked.count() // query_block) or 1, index_blocks)), "first")
    again = common.materialise(unsettled(asked, ranked(first, k), k, size, model, radius), "again")
    left = again.count()
    return ranked(first.union(searched(again, rows, k, size, model, None, (-(-left // query_block), index_blocks))) if left else first, k)
