"""Packing by concatenate and cut.

Pass 1 tokenizes each partition once, writes ids with their place inside the partition and adds up the
partition's tokens. The prefix sums of the partition totals (one number a partition) turn places into
global offsets, and pass 2 cuts each document at the multiples of the window: a document that crosses a
cut gives one boundary record on either side. No shuffle; memory is bounded by one batch of documents.

Nulls and empty texts are documents of one token (the end token). Repeated rows are packed as often as
they come. An empty table gives no pieces. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, added: bool = False) -> DataFrame:
    """(doc_id, part, part_start, n, wide, ids) as a table: wide tells 4 bytes an id from 2."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for few in common.rows(batch, "text", 8_000_000):
                out = []
                for doc_id, text in zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist(), strict=True):
                    ids = np.append(tokens.token_ids(text, vocabulary, added), np.uint32(end_id))
                    wide = bool(ids.max() >= 1 << 16)
                    out.append((doc_id, part, at, len(ids), wide, ids.astype("<u4" if wide else "<u2").tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["doc_id", "part", "part_start", "n", "wide", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, part int, part_start long, n long, wide boolean, ids binary")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 2048, end_id: int = 1, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row a piece: a run of a document's ids and its place in a sequence of at most window ids.

    padded_length is what the sequence is padded to: the window, but a sequence whose length is a power of
    two stays as it is; only the last can be short. with_ids adds the ids themselves. added: strings of the vocabulary's
    added tokens are these tokens, not ordinary text.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    table = common.materialise(tokenized(docs, vocabulary, end_id, added), "packing")
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number a partition
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    last, rest = total // window, total % window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, runs = [], []
            for doc_id, part, at, n, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "part_start", "n", "wide", "ids")), strict=True):
                ids, at = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4"), at + base[part]
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    stop = min(n, start + window - offset)
                    padded = window if sequence < last or rest & (rest - 1) else rest
                    out.append((doc_id, start, stop - start, zlib.crc32(ids[start:stop]), n, sequence, offset, padded))
                    if with_ids:
                        runs.append(ids[start:stop])
                    start = stop
            if out:
                arrays = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                names = [x.split()[0] for x in PIECE.split(", ")]
                if with_ids:
                    arrays, names = [*arrays, pa.array(runs, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return table.mapInArrow(cut, PIECE + ", ids array<long>" * with_ids)
