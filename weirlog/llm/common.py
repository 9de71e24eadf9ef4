"""What several training-data operators share: shared-folder tables, folds, words, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.sources.shared import materialise as materialise

#: What is not a word character (anything of ASCII but digits and letters), and what is one, of either case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same for UTF-8 bytes: lower-cases A-Z and turns what separates words into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def rows(batch: pa.RecordBatch, text: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most so many bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and whatever is not ASCII."""
    return utf8(text).translate(WORD_BYTES).split()


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, each distinct word hashed once."""
    if not words:
        return np.empty(0, np.uint64)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(df: DataFrame, label: str, columns: list[str], per_label: int, salt: int = 0) -> DataFrame:
    """About per_label distinct rows of (label, columns) for each label that is not null, chosen by a hash: the same rows at every run.

    A hash threshold from the number of distinct rows of a label draws them, so no task ranks a label's rows, and
    copies of one row, however many, count as one. `_drawn` is what they were drawn by: who needs a strict bound takes the
    least. All rows come where there are at most per_label. A row a label passes the driver, so labels are few.
    """
    span = 1 << 40
    drawn = df.where(F.col(label).isNotNull()).select(label, *columns).withColumn("_drawn", F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(span)))
    sizes = drawn.groupBy(label).agg(F.approx_count_distinct("_drawn", 0.03).alias("n")).collect()
    rate = F.lit(0)
    for r in sizes:
        share = span if r.n <= 0.9 * per_label else min(span, int(1.2 * per_label / r.n * span) + 1)
        rate = F.when(F.col(label) == F.lit(r[label]), F.lit(share)).otherwise(rate)
    return drawn.where(F.col("_drawn") < rate).distinct()


def piece(text: str, longest: int) -> Column:
    """The text, or of a longer one a run of so many characters, begun where a hash of the text says."""
    begin = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - longest + 1, F.lit(1))).cast("int") + 1
    return F.when(F.length(text) <= longest, F.col(text)).otherwise(F.substring(F.col(text), begin, F.lit(longest)))
