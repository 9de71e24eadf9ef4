"""Language identification by compression.

Each language gets a raw-content zstandard dictionary of its own text. A text is encoded once with each
dictionary and belongs to the language whose encoding is smallest; where the two smallest sizes are
nearly the same, the text is rejected. Texts are lower-cased and runs of anything but letters become one
space, so that capitals, digits and symbols say nothing; a word that repeats in a row is one word, or its
own history would hide the dictionary. Combining marks belong to their words. The whole text counts: it is encoded in
pieces of whole words, for the same reason. One rule holds for all lengths: the text is read in a circle, from evenly
spaced words, as often as it takes to encode `least` bytes, which tells the sizes of shorter texts apart by less than a byte.

Null texts and texts without a letter give 'und', rejected, with score 0. Ties go to the language with more
labelled texts, then to the one that sorts first. Texts without labels are never learned from. Without a learned language all is 'und'.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


NO_LETTERS = re.compile(r"[\W\d_]+")  # of texts without combining marks, which re takes for no letters
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def runs(points: list[int]) -> str:
    """Ascending code points as the ranges of a character class."""
    edges = [i for i in range(len(points)) if not i or points[i] != points[i - 1] + 1]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip(edges, [*edges[1:], len(points)], strict=True))


@cache
def marks() -> tuple[re.Pattern, re.Pattern]:
    """What finds a mark of the basic plane, and what NO_LETTERS is where marks count as letters."""
    every = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]
    kept = sorted({*every, *(c for c in range(0x110000) if not NO_LETTERS.match(chr(c)))})
    return re.compile(f"[{runs([c for c in every if c < 0x10000])}]"), re.compile(f"[^{runs(kept)}]+")


def between(text: str) -> re.Pattern:
    """What separates the words of this text: everything but letters and the marks that combine with them."""
    return NO_LETTERS if text.isascii() or not (marks()[0].search(text) or ASTRAL.search(text)) else marks()[1]


def letters(text: str | None) -> bytes:
    """The text's words in lower case, runs of one word as one, joined by single spaces; empty if it has no letter."""
    if not text:
        return b""
    text = text.lower()
    plain = " ".join(word for word, _ in groupby(between(text).sub(" ", text).split()))
    return plain.encode("utf-8", "replace") if any(map(str.isalpha, plain)) else b""


def learn(labelled: DataFrame, per_language: int = 500, dictionary_bytes: int = 512_000, longest: int = 20_000) -> dict[str, bytes]:
    """A dictionary for each language, from at most per_language distinct rows, of each longer text a piece of longest characters; frequent languages first."""
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    few = common.bounded_sample(known, "lang", ["doc_id", "text"], per_language)
    few = common.materialise(few.select("lang", "doc_id", common.piece("text", longest).alias("text"), "_drawn"), "labelled")
    drawn = sorted(((r.lang, r["_drawn"], r.doc_id is not None, r.doc_id or 0, r.text) for r in few.toLocalIterator()))  # partition by partition
    texts: dict[str, dict[bytes, None]] = {}
    taken: dict[str, int] = {}
    for lang, *_, text in drawn:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= per_language and (plain := letters(text)):
            texts.setdefault(lang, {})[plain] = None
    return {lang: b" ".join(x)[:dictionary_bytes] for lang, x in sorted(texts.items(), key=lambda x: (-counts[x[0]], x[0]))}


@lru_cache(maxsize=8)
def compressors(dictionaries: tuple[bytes, ...], level: int) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def pieces(plain: bytes, piece: int) -> list[bytes]:
    """The text cut before words into pieces of at most so many bytes; a longer word is cut between characters."""
    found, at = [], 0
    while len(plain) - at > piece:
        end = plain.rfind(b" ", at + 1, at + piece + 1)
        if end < 0:
            end = at + piece
            while plain[end] & 0xC0 == 0x80:
                end -= 1
        found.append(plain[at:end])
        at = end
    return [*found, plain[at:]]


def turns(plain: bytes, least: int) -> list[bytes]:
    """The text from evenly spaced words on, round to where it began: as often as it takes to have so many bytes, at most once a word."""
    if len(plain) >= least:
        return [plain]
    starts = [0, *(i + 1 for i, c in enumerate(plain) if c == 32)]
    n = min(len(starts), -(-least // len(plain)))
    return [plain[i:] + b" " + plain[:i] for i in (starts[j * len(starts) // n] for j in range(n))]


def sizes(plain: bytes, made: list[zstandard.ZstdCompressor], piece: int = 1000, least: int = 3000) -> list[int]:
    parts = [p for turn in turns(plain, least) for p in pieces(turn, piece)]
    return [sum(len(x.compress(p)) for p in parts) for x in made]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, least_margin: float = 0.001) -> DataFrame:
    """docs with lang_pred, score, margin and rejected; docs needs a text, other columns stay as they are.

    margin is what the second smallest encoding is larger than the smallest, relative to it. A column of
    docs that has one of these names is replaced.
    """
    added = ["lang_pred", "score", "margin", "rejected"]
    names, contents = list(dictionaries), tuple(dictionaries.values())
    kept = docs.drop(*added)
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(False).alias("rejected")).schema
    at = kept.columns.index("text")

    def one(text: str | None, made: list) -> tuple[str, float, float, bool]:
        plain = letters(text)
        if not plain or not made:
            return "und", 0.0, 0.0, True
        ranked = sorted(zip(sizes(plain, made), names, strict=True), key=lambda x: x[0])  # names stand in the order for ties
        margin = (ranked[1][0] - ranked[0][0]) / ranked[0][0] if len(ranked) > 1 else 1.0
        return ranked[0][1], 0.5 + 0.5 * math.tanh(10 * margin), margin, margin < least_margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors(contents, level)
        for batch in batches:
            for few in common.rows(batch, "text", 8_000_000):
                found = [one(x, made) for x in few.column(at).to_pylist()]
                columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*few.columns, *columns], [*few.schema.names, *added])

    return kept.mapInArrow(run, schema)
