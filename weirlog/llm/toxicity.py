"""Toxicity by a weighted lexicon.

Texts are folded first: letters of other alphabets that look like Latin ones, digits and symbols that
stand for letters, and letters that are drawn alike come to one form. An Aho-Corasick automaton then
finds the lexicon's words, beginnings of longer words and exception phrases in one pass. A match inside an
exception phrase does not count. The sum of the weights, as it is and by the text's length, goes
through a logistic curve.

Words, weights, exception phrases and the curve are learned from labelled texts: a word gets the log of
the ratio of its document frequencies in toxic and other texts, if it is frequent enough and stands beside
enough different words (what only occurs in copies of one text does not). The learning sample is bounded.

Texts of any length are scored whole, in time that grows with their length. Null and empty texts have no match and get the curve's value at zero. Without labels of both kinds the
lexicon is empty and all score 0. Null labels are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of the Greek and Cyrillic alphabets and the Latin ones they look like.
LOOKALIKES = str.maketrans("аеорсухіјѕԁԛԝһвкмнтαεορτυχικνγω", "aeopcyxijsdqwhbkmhtaeoptuxikvyw")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
#: Digits and symbols that stand for letters; l, i and 1 are one letter here.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i"}
INSIDE = re.compile(rb"(?<=[a-z0-9])[@$!|](?=[a-z0-9])")
SYMBOLS = {b"@": b"a", b"$": b"s", b"!": b"i", b"|": b"i"}
TABLE = bytes(ord(STANDS_FOR.get(chr(c).lower(), chr(c).lower())) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
SEPARATORS = re.compile("[ -¿ -⁯　-〿]")


def folded(text: str | None) -> list[bytes]:
    """The words of a text in folded form."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = SEPARATORS.sub(" ", text)
        if FOREIGN.search(text):
            text = text.translate(LOOKALIKES)
    raw = text.encode("utf-8", "replace")
    if any(x in raw for x in (b"@", b"$", b"!", b"|")):
        raw = INSIDE.sub(lambda m: SYMBOLS[m[0]], raw)
    return raw.translate(TABLE).split()


@dataclass(frozen=True)
class Lexicon:
    """Weights by pattern: whole words, beginnings of longer words (with a closing *), and exception phrases."""

    weights: dict[bytes, float] = field(default_factory=dict)
    exceptions: tuple[bytes, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, -50.0)

    def key(self) -> tuple:
        return tuple(self.weights.items()), self.exceptions


@lru_cache(maxsize=8)
def automaton(key: tuple) -> ahocorasick.Automaton | None:
    weights, exceptions = key
    made = ahocorasick.Automaton()
    for pattern, weight in weights:
        text = " " + pattern.decode("latin-1")
        text, whole = (text[:-1], False) if text.endswith("*") else (text + " ", True)
        made.add_word(text, (weight, len(text) - (2 if whole else 1)))
    for phrase in exceptions:
        made.add_word(text := f" {phrase.decode('latin-1')} ", (None, len(text) - 2))
    if not len(made):
        return None
    made.make_automaton()
    return made


def measured(words: list[bytes], made: ahocorasick.Automaton | None) -> tuple[float, float]:
    """The sum of the weights found, on a log scale, as it is and for a hundred words."""
    if made is None or not words:
        return 0.0, 0.0
    text = " " + b" ".join(words).decode("latin-1") + " "
    found, exempt = {}, []
    for end, (weight, length) in made.iter(text):
        whole = text[end] == " "
        begin = end - length + (not whole)
        if not whole and text[end + 1] == " ":  # a beginning is one of longer words
            continue
        if weight is None:
            exempt.append((begin, end))
        else:  # a word counts once, by its largest weight
            found[begin] = max(weight, found.get(begin, 0.0))
    exempt.sort()
    total, k, reach = 0.0, 0, -1
    for at in sorted(found):  # one sweep over words and phrases
        while k < len(exempt) and exempt[k][0] <= at:
            reach, k = max(reach, exempt[k][1]), k + 1
        total += found[at] if at >= reach else 0.0
    return math.log1p(total), math.log1p(100 * total / len(words))


def curve_of(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A logistic curve by Newton's method, held back a little."""
    x, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3), x.T @ (y - p) - 0.02 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 5000, least_texts: int = 8, least_weight: float = 2.0, longest: int = 20_000) -> Lexicon:
    """A lexicon from at most per_class labelled texts of each kind, of each longer text a piece of longest characters."""
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = common.bounded_sample(marked, "toxic", ["doc_id"], per_class).select("doc_id", "toxic")  # about 1.2 * 2 * per_class rows
    met = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    met = common.materialise(met.select(common.piece("text", longest).alias("text"), "toxic"), "labelled")  # an id may have many texts
    few = common.bounded_sample(met, "toxic", ["text"], per_class, salt=1)
    drawn = sorted((r.toxic, r["_drawn"], r.text) for r in few.toLocalIterator())  # partition by partition; about as many as the bound
    texts = sorted((text, toxic) for kind in (0, 1) for toxic, _, text in [x for x in drawn if x[0] == kind][:per_class])
    del drawn
    kinds = Counter(t for _, t in texts)
    if len(kinds) < 2:
        return Lexicon()
    seen = ({}, {})  # by pattern: texts of each kind
    beside, within, phrases = defaultdict(set), defaultdict(set), (Counter(), Counter())
    pool: dict[bytes, bytes] = {}
    read = [([pool.setdefault(w, w) for w in folded(text)], toxic) for text, toxic in texts]  # a word is held once
    del texts
    for words, toxic in read:
        own = set(words) | {w[:n] + b"*" for w in set(words) for n in (5, 6, 7) if len(w) > n}
        for w in own:
            seen[toxic][w] = seen[toxic].get(w, 0) + 1
    weight = {w: math.log((n + 0.5) / (kinds[1] + 1)) - math.log((seen[0].get(w, 0) + 0.5) / (kinds[0] + 1)) for w, n in seen[1].items() if n >= least_texts}
    weight = {w: x for w, x in weight.items() if x >= least_weight}
    for words, toxic in read:
        for i, w in enumerate(words):
            hits = [p for p in (w, *(w[:n] + b"*" for n in (5, 6, 7) if len(w) > n)) if p in weight]
            around = words[max(0, i - 1) : i], words[i + 1 : i + 2]
            for p in hits if toxic else ():
                beside[p].add((tuple(around[0]), tuple(around[1])))
                within[p].add(w)
            if hits:
                phrases[toxic].update({b" ".join([*around[0], w]) if around[0] else b"", b" ".join([w, *around[1]]) if around[1] else b""} - {b""})
    weight = {p: x for p, x in weight.items() if len(beside[p]) >= max(4, seen[1][p] // 2) and (not p.endswith(b"*") or len(within[p]) >= 4 and seen[1][p] >= 3 * least_texts)}
    exceptions = tuple(sorted(p for p, n in phrases[0].items() if n >= 3 and n * kinds[1] > phrases[1][p] * kinds[0] and any(w in weight for w in p.split())))
    lexicon = Lexicon(dict(sorted(weight.items())), exceptions)
    made = automaton(lexicon.key())
    features = np.array([measured(words, made) for words, _ in read])
    return Lexicon(lexicon.weights, exceptions, curve_of(features, np.array([t for _, t in read], float)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with score (0 to 1); other columns stay, one of this name is replaced."""
    kept = docs.drop("score")
    at, (a, b, c) = kept.columns.index("text"), lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(lexicon.key())
        for batch in batches:
            for few in common.rows(batch, "text", 8_000_000):
                found = (measured(folded(x), made) for x in few.column(at).to_pylist())
                scores = pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c)))) for x, y in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*few.columns, scores], [*few.schema.names, "score"])

    return kept.mapInArrow(run, kept.select("*", F.lit(0.0).alias("score")).schema)
