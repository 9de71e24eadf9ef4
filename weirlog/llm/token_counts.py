"""Exact length histogram of a corpus in tokens, answered for every context limit.

Documents are counted by encoded length inside the workers; the shuffle moves one row a length and batch.
Suffix sums over the histogram then give, for each length L that occurs, totals, quantiles and truncated
totals for a context limit of L. Between two lengths that occur the answers follow from the next
larger row: docs_longer(L) and truncated_tokens(L) are linear there (see at_limit).

Null and empty texts have length 0. An empty table gives an empty histogram. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens


def histogram(docs: DataFrame, vocabulary: str | None = None, text: str = "text", added: bool = False) -> DataFrame:
    """(n_tokens, n_docs), a row a length that occurs, as a table: texts are encoded once. added as in tokens."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (tokens.whole_encoder if added else tokens.encoder)(vocabulary)
        for batch in batches:
            found: Counter[int] = Counter()
            for few in common.rows(batch, "text", 8_000_000):
                found.update(len(encode(x)) if x else 0 for x in few.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(found), list(found.values()))], ["n_tokens", "n_docs"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return common.materialise(counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def suffix_sums(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """For each length L: documents and tokens up to L and beyond, the share of documents of at most L
    (its quantile) and the tokens that are left if every document is cut at L.

    Sums run inside blocks of lengths and over the blocks' totals, so no task sees the whole histogram.
    """
    one = lengths.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / block).alias("block"))
    totals = one.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    beyond = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    totals = totals.select("block", *(F.coalesce(F.sum(f"block_{x}").over(beyond), F.lit(0)).alias(f"later_{x}") for x in ("docs", "tokens")), *(F.sum(f"block_{x}").over(every).alias(f"all_{x}") for x in ("docs", "tokens")))
    after = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    inside = {x: F.coalesce(F.sum(x).over(after), F.lit(0)) for x in ("n_docs", "tokens")}
    return (
        one.withColumns({"docs_longer": inside["n_docs"], "tokens_longer": inside["tokens"]})
        .join(totals, "block")
        .withColumns({"docs_longer": F.col("docs_longer") + F.col("later_docs"), "tokens_longer": F.col("tokens_longer") + F.col("later_tokens")})
        .select(
            "n_tokens",
            "n_docs",
            (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"),
            "docs_longer",
            (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_within"),
            "tokens_longer",
            (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
            ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
            F.col("all_tokens").alias("total_tokens"),
        )
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for a limit: documents longer than it and the tokens that are left after cutting there."""
    above = F.col("n_tokens") > limit
    return sums.agg(
        F.coalesce(F.sum(F.when(above, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
    ).select(F.lit(limit).cast("long").alias("context_limit"), "docs_longer", "truncated_tokens")
