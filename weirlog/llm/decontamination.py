"""Benchmark decontamination by winnowing, in DataFrame operations only.

An item's windows are all its runs of `window` words, or the whole item if it has fewer. Of each window
the smallest hash of its k-word grams is its fingerprint; equal windows have equal fingerprints, so a
join of fingerprints meets every shared run of at least a window's length. Of a document a fingerprint is kept only
where it differs from that of the window before (windows that slide over one smallest gram share it), and anew after as
many windows as can share a gram. Each hit is then extended: the texts of the windows that it stands for are compared with
the items' windows exactly, so no hash decides alone.

One scan of the documents serves windows of all lengths. A document's grams stay inside its row: hashes are made by
array expressions, exploded and met with the benchmark's fingerprints in one generated stage, and only hits leave it,
with a header row a document. The fingerprints are broadcast if they are at most `most_broadcast`, of 100 bytes on average. Beyond that the
same steps are sort-merge joins, and what is shuffled there is fingerprints with places; texts are fetched, once a
document, for what has met.

Null and empty texts have no words and are clean. Items without words have no windows. An item is its
item_id; a null item_id is the empty text. Repeated rows give repeated results. Other columns of either
table are ignored. Very long texts are one row's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def words(text: str) -> Column:
    """The words of a text column; none if it is null."""
    cut = F.split(F.translate(F.col(text), common.UPPER, common.LOWER), common.NOT_WORD)
    return F.coalesce(F.filter(cut, lambda w: w != ""), F.array().cast("array<string>"))


def shape(window: int) -> tuple[int, int]:
    """Words in a gram, and grams in a window."""
    k = -(-3 * window // 5)
    return k, window - k + 1


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once a row: Catalyst may repeat an expression, but not a lambda's argument."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prints(hashes: Column, window: int) -> Column:
    """For each window of the words (given as hashes) the smallest gram hash in it."""
    k, grams = shape(window)

    def grams_of(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(F.lit(window), h, *(F.get(hashes, i + n) for n in range(1, k))))

    def smallest(gram: Column) -> Column:
        return F.transform(gram, lambda g, i: F.least(g, *(F.get(gram, i + n) for n in range(1, grams)))) if grams > 1 else gram

    return F.slice(bound(grams_of(hashes), smallest), F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.lit(0)))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(length, print, window_text, items): a row a distinct window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    own = F.lit(None).cast("array<bigint>")
    for length in range(1, window + 1):
        own = F.when(F.col("length") == length, prints(hashes_of(F.col("words")), length)).otherwise(own)
    each = items.select("item", "words", "length", F.posexplode(own).alias("start", "print"))
    text = F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("length")))
    return each.select("item", "length", "print", text.alias("window_text")).groupBy("length", "print", "window_text").agg(F.collect_set("item").alias("items"))


def text_key(text: str = "text") -> Column:
    """Two hashes that tell texts apart."""
    return F.struct(F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(1), text).alias("h1"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_broadcast: int = 1_000_000) -> DataFrame:
    """For each document: doc_id, text_key (two hashes of its text), n_words, spans (start and length of hit windows), items."""
    windows = common.materialise(item_windows(benchmark, window), "windows")
    size = F.octet_length("window_text") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    sizes = windows.groupBy("length").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()  # at most `window` rows
    few = sum(r.n for r in sizes) <= most_broadcast and sum(r.bytes for r in sizes) <= 100 * most_broadcast
    small = F.broadcast if few else (lambda df: df)
    known = windows.select("print", F.lit(True).alias("met")).distinct()
    lengths = sorted(r.length for r in sizes)
    share = F.element_at(F.array(*(F.lit(shape(n)[1]) for n in range(1, window + 1))), F.col("length"))  # windows that can share a gram
    new = (F.col("at") % share == 0) | ~F.get("prints", F.col("at") - 1).eqNullSafe(F.col("print"))
    base = docs.select("doc_id", text_key().alias("text_key"), words("text").alias("words"))
    of = lambda hashes: [F.struct(F.lit(n).alias("length"), prints(hashes, n).alias("prints")) for n in lengths]
    none = F.array().cast("array<struct<length: int, prints: array<bigint>>>")
    every = bound(hashes_of(F.col("words")), lambda hashes: F.concat(none, F.array(*of(hashes)))) if lengths else none
    if few:
        head = F.array(F.struct(F.lit(None).cast("int").alias("length"), F.array(F.lit(None).cast("bigint")).alias("prints")))  # one row without a fingerprint
        own = base.withColumn("every", F.concat(head, every))  # a column of its own, so that what follows runs in one generated stage
        own = own.select("doc_id", "text_key", "words", F.inline("every")).select("doc_id", "text_key", "words", "length", "prints", F.posexplode("prints").alias("at", "print"))
        own = own.where(F.col("length").isNull() | new).drop("prints").join(small(known), "print", "left").where(F.col("met") | F.col("length").isNull())
    else:
        own = base.withColumn("every", every).select("text_key", F.inline("every")).select("text_key", "length", "prints", F.posexplode("prints").alias("at", "print"))
        met = own.where(new).drop("prints").join(known, "print", "left_semi").groupBy("text_key").agg(F.collect_set(F.struct("length", "at")).alias("marks"))
        head = F.array(F.lit(None).cast("struct<length: int, at: int>"))
        own = base.join(met, "text_key", "left").withColumn("mark", F.explode(F.concat(head, F.coalesce("marks", F.array().cast("array<struct<length: int, at: int>>")))))
        own = own.select("doc_id", "text_key", "words", "mark.length", "mark.at")
    last = F.least(F.size("words") - F.col("length"), F.col("at") + share - 1 - F.col("at") % share)
    own = own.select("doc_id", "text_key", "words", "length", F.explode_outer(F.when(F.col("length").isNotNull(), F.sequence(F.col("at"), last))).alias("start"))
    text = F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("length")))
    alone = F.concat(F.lit("\0"), F.col("text_key.h0").cast("string"))  # no window's text, and none that many rows share
    hits = own.select("doc_id", "text_key", F.size("words").alias("n_words"), "start", "length", F.when(F.col("start").isNotNull(), text).otherwise(alone).alias("window_text"))
    hits = hits.join(small(windows.select("length", "window_text", "items")), ["length", "window_text"], "left")
    span = F.when(F.col("items").isNotNull(), F.struct("start", "length"))
    found = hits.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum(F.col("start").isNull().cast("int")).alias("copies"),
        F.collect_set(span).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def hit_words(spans: str = "spans") -> Column:
    """How many words the spans cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(seen: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["total"] + F.greatest(F.lit(0), end - F.greatest(seen["end"], span["start"]))).alias("total"))

    return F.aggregate(F.array_sort(spans), start, add, lambda seen: seen["total"])
