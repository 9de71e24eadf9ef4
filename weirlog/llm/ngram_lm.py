"""Language model scoring by deleted interpolation.

P(w | context) mixes maximum-likelihood estimates of the orders 1 to n and the uniform distribution over
the vocabulary and one unknown word. The mixture weights depend on the bucket (powers of two) of the
context's frequency and are learned by expectation-maximisation on held-out counts: part of the training
documents is set aside, the rest gives the counts that the weights are fitted against. Scoring then uses
the counts of all training documents.

How the counts travel. Each task cuts its documents into blocks of about `block_tokens` tokens, held as a
word table and a stream of places in it. A block asks for each of its n-grams once, whatever its frequency:
sorted hashes with the block's own training counts, dealt to buckets by the top bits of the hash. A bucket
adds up what all blocks know and answers every block with the totals in the order of its hashes. So a
frequent n-gram costs a bucket one entry a block, no key is hot, and n-grams move as sorted arrays instead
of rows. The number of buckets follows the size of the corpus. A block and its answers then meet to score;
a block is bounded, so is a task's memory. A context's count is the count of the n-gram before the token,
or the number of documents at a text's start, so contexts need no counts of their own.

Tokens are the white-space separated words, A-Z lower-cased, and one end token after each text. Null and
empty texts are their end token. Repeated rows count as often as they come. A null doc_id has the fold of
the empty text. Without training documents everything is unknown and the uniform share is all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END, BEGIN = b"\n", b"\t"  # no word can be one of these
TRAIN, TUNE, TEST = 0, 1, 2
BUCKETS, STEPS_PER_OCTAVE, REACH = 24, 4, 60


@dataclass(frozen=True)
class Plan:
    order: int
    bucket_bits: int
    block_tokens: int


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of equal weight together: what is small compresses to next to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T


def squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def spread(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), kind)


def packed_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, bytes of equal weight together."""
    steps = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return squeezed(planes(steps))


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    own = spread(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(own.T).view(kind).ravel()


def unpacked_hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, "<u8"), dtype=np.uint64)


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with their end tokens, and the number of tokens of each."""
    words, lengths = [], []
    for text in texts:
        own = common.utf8(text).lower().split()
        words += own
        words.append(END)
        lengths.append(len(own) + 1)
    return common.hashed(words), np.array(lengths, np.int64)


def grams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each token; begin tokens fill up in front."""
    begin = np.uint64(xxhash.xxh3_64_intdigest(BEGIN))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found = [common.mixed(tokens)]
    for n in range(1, order):
        back = np.full(len(tokens), begin)
        back[n:] = tokens[: max(0, len(tokens) - n)]
        back = np.where(place >= n, back, begin)
        found.append(common.mixed(found[-1] * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(n)))
    return found


def blocks_of(docs: DataFrame, plan: Plan) -> DataFrame:
    """(block, ids, folds, lengths, table, places): odd blocks hold the tuning documents, even ones the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 24, 0
        held = {odd: ([], [], []) for odd in (0, 1)}
        size = {0: 0, 1: 0}

        def flush(odd: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, folds, texts = held[odd]
            if ids:
                tokens, lengths = stream(texts)
                table, places = np.unique(tokens, return_inverse=True)
                row = ((part + made) * 2 + odd, ids, folds, lengths.tolist(), squeezed(table), squeezed(planes(places.astype("<u4"))))
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["block", "ids", "folds", "lengths", "table", "places"])
                held[odd], size[odd], made = ([], [], []), 0, made + 1

        for batch in batches:
            for few in common.rows(batch, "text", 2_000_000):
                for doc_id, fold, text in zip(*(few.column(c).to_pylist() for c in ("doc_id", "fold", "text")), strict=True):
                    odd = int(fold == TUNE)
                    for x, value in zip(held[odd], (doc_id, fold, text), strict=True):
                        x.append(value)
                    size[odd] += 1 + len(text or "") // 6
                    if size[odd] >= plan.block_tokens:
                        yield from flush(odd)
        for odd in (0, 1):
            yield from flush(odd)

    return docs.mapInArrow(run, "block long, ids array<long>, folds array<int>, lengths array<long>, table binary, places binary")


def distinct_grams(lengths: np.ndarray, table: bytes, places: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct n-gram hashes in order, and where each token's n-grams stand there (a row an order)."""
    found = grams(spread(table, "<u8")[unplaned(places, "<u4")], lengths, order)
    distinct, place = np.unique(np.concatenate(found), return_inverse=True)
    return distinct, place.reshape(order, -1)


def asked(blocks: DataFrame, plan: Plan) -> DataFrame:
    """(block, bucket, n, hashes, counts): what a block knows and asks for; counts: training, tuning, whether a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"])
                distinct, place = distinct_grams(lengths, row["table"], row["places"], plan.order)
                part = np.repeat(np.array(row["folds"]), lengths)
                counts = np.array([np.bincount(place[:, part == p].ravel(), minlength=len(distinct)) for p in (TRAIN, TUNE)] + [np.bincount(place[0], minlength=len(distinct)) > 0]).astype("<u4")
                bucket = (distinct >> np.uint64(63 - plan.bucket_bits) >> np.uint64(1)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 62))  # runs of one bucket: none is empty
                out = [(row["block"], bucket[a], int(b - a), packed_hashes(distinct[a:b]), squeezed(counts[:, a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "bucket", "n", "hashes", "counts"])

    return blocks.select("block", "folds", "lengths", "table", "places").mapInArrow(run, "block long, bucket int, n long, hashes binary, counts binary")


def answered(asks: DataFrame) -> DataFrame:
    """(block, bucket, reply): the totals, in training and in tuning documents, of what the block asked for; and the bucket's share of the vocabulary."""

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        distinct, place = np.unique(np.concatenate([unpacked_hashes(x) for x in pdf["hashes"]]), return_inverse=True)
        sums, at, places = np.zeros((3, len(distinct)), np.int64), 0, []
        for raw in pdf["counts"]:
            part = spread(raw, "<u4").reshape(3, -1)
            places.append(place[at : at + part.shape[1]])
            sums[:, places[-1]] += part  # a block has a hash once
            at += part.shape[1]
        total = sums[:2].astype("<u8")  # of a large corpus, more than 32 bits
        first = np.arange(len(places)) == 0
        words = ((sums[2] > 0) & (sums[:2].sum(0) > 0)).sum(), ((sums[2] > 0) & (sums[0] > 0)).sum()
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "reply": [squeezed(planes(total[:, x].ravel())) for x in places]} | {k: np.where(first, n, 0) for k, n in zip(("words", "base_words"), words, strict=True)})

    return asks.groupBy("bucket").applyInPandas(add_up, "block long, bucket int, reply binary, words long, base_words long")


def estimates(counts: np.ndarray, lengths: np.ndarray, documents: int, tokens: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities by order (row 0 uniform, row 1 words, ...) and the bucket of the longest seen context of each token.

    The bucket is 0 if no context was seen, else it tells the length of the longest seen and the power of two of its count.
    """
    order, size = counts.shape
    p, bucket = np.zeros((order + 1, size)), np.zeros(size, np.int64)
    p[0] = 1.0 / (words + 1)
    p[1] = counts[0] / tokens if tokens else 0.0
    starts = np.cumsum(lengths) - lengths
    for n in range(2, order + 1):
        context = np.concatenate([[0], counts[n - 2][:-1]])
        context[starts] = documents
        seen = context > 0
        p[n, seen] = counts[n - 1][seen] / context[seen]
        c = context
        bucket[seen] = (n - 2) * BUCKETS + 1 + np.minimum(np.log2(c[seen]).astype(np.int64), BUCKETS - 2)
    return p, bucket


def fitted(cells: np.ndarray, counts: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket (rows) from held-out counts of cells: columns bucket and log ratios of each order to the uniform one."""
    weights = np.full(((order - 1) * BUCKETS + 1, order + 1), 1.0 / (order + 1))
    for b in range(len(weights)):
        seen = min(order, 1 if b == 0 else 2 + (b - 1) // BUCKETS)
        own = cells[:, 0] == b
        w = np.zeros(order + 1)
        w[: seen + 1] = 1.0 / (seen + 1)
        ratios = np.where(cells[own, 1:] <= -REACH * STEPS_PER_OCTAVE, 0.0, 2.0 ** (cells[own, 1:] / STEPS_PER_OCTAVE))
        ratios = np.column_stack([np.ones(len(ratios)), ratios])
        total = np.concatenate([counts[own], [1.0]])  # one event for the uniform share, so that it stays above zero
        ratios = np.vstack([ratios, np.eye(order + 1)[0]])
        for _ in range(rounds):
            share = ratios * w
            mass = share.sum(1, keepdims=True)
            w = (total[:, None] * share / mass).sum(0) / total.sum()
        weights[b] = w
    return weights


def scored(docs: DataFrame, held_out: str = "held_out", order: int = 2, block_tokens: int = 1_000_000, chars_per_bucket: int = 4_000_000, tune_folds: int = 8) -> DataFrame:
    """docs must have doc_id, text and a boolean column that marks what is not learned from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score: base-10 logarithms of
    the text's probability under smoothed word frequencies and under the model.
    """
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(order, max(0, math.ceil(math.log2(max(1, chars / chars_per_bucket)))), block_tokens)
    tune = common.fold(F.concat(F.lit("tune"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), tune_folds) == 0
    parts = F.when(F.col(held_out), TEST).when(tune, TUNE).otherwise(TRAIN)
    blocks = common.materialise(blocks_of(docs.select("doc_id", parts.cast("int").alias("fold"), "text"), plan), "blocks")
    answers = common.materialise(answered(asked(blocks, plan)), "counts")
    words, base_words = (x or 0 for x in answers.agg(F.sum("words"), F.sum("base_words")).first())
    sizes = blocks.select(F.explode(F.arrays_zip("lengths", "folds")).alias("x")).groupBy("x.folds").agg(F.sum("x.lengths").alias("n"), F.count("*").alias("documents"))
    n = {r.folds: np.array([r.n, r.documents]) for r in sizes.collect()}  # three rows at most
    none = np.zeros(2, np.int64)
    base_tokens, base_docs = (int(x) for x in n.get(TRAIN, none))
    tokens, documents = (int(x) for x in n.get(TRAIN, none) + n.get(TUNE, none))
    odd = F.col("block").bitwiseAND(F.lit(1)) == 1

    def met(some: DataFrame, replies: DataFrame, run, schema: str) -> DataFrame:
        return some.groupBy("block").cogroup(replies.select("block", "bucket", "reply").groupBy("block")).applyInPandas(run, schema)

    def counted(block: pd.DataFrame, reply: pd.DataFrame) -> tuple[pd.Series, np.ndarray, np.ndarray]:
        """The block's row, its lengths, and training and tuning counts of each token's n-grams."""
        row = block.iloc[0]
        lengths = np.array(row["lengths"])
        _, place = distinct_grams(lengths, row["table"], row["places"], order)
        totals = np.concatenate([unplaned(x, "<u8").reshape(2, -1) for x in reply.sort_values("bucket")["reply"]], axis=1)
        return row, lengths, totals.astype(np.int64)[:, place]

    def cells_of(block: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        _, lengths, counts = counted(block, reply)
        p, bucket = estimates(counts[0], lengths, base_docs, base_tokens, base_words)
        with np.errstate(divide="ignore"):
            ratios = np.clip(np.round(STEPS_PER_OCTAVE * np.log2(p[1:] / p[0])), -REACH * STEPS_PER_OCTAVE, REACH * STEPS_PER_OCTAVE)
        cells, times = np.unique(np.column_stack([bucket, *ratios.astype(np.int64)]), axis=0, return_counts=True)
        return pd.DataFrame({"cell": [x.tolist() for x in cells], "n": times})

    told = met(blocks.where(odd), answers.where(odd), cells_of, "cell array<int>, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    known = told.toPandas()  # bounded by the number of cells, not by the corpus
    weights = fitted(np.array(known["cell"].tolist(), np.float64).reshape(-1, order + 1), known["n"].to_numpy(np.float64), order)

    def score_of(block: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        row, lengths, counts = counted(block, reply)
        every = counts.sum(0)
        p, bucket = estimates(every, lengths, documents, tokens, words)
        model = np.log10((weights[bucket].T * p).sum(0))
        base = np.log10((every[0] + 0.5) / (tokens + 0.5 * (words + 1)))
        sums = [np.add.reduceat(x, np.cumsum(lengths) - lengths) for x in ((every[0] > 0).astype(np.int64), base, model)]
        return pd.DataFrame({"doc_id": pd.array(list(row["ids"]), "Int64"), "held_out": np.array(row["folds"]) == TEST, "n_tokens": lengths, "n_known": sums[0], "train_tokens": tokens, "base_score": sums[1], "score": sums[2]})

    return met(blocks, answers, score_of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
