"""Results of token ids, language model, language identification and toxicity held against plain versions, with long texts, ties and repeats."""

import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import zstandard

from weirlog.llm import common, language_id, ngram_lm, packing, queries, token_counts, tokens, toxicity

SF = "/root/testdata/sf0.001"
END = "<|endoftext|>"
MARKED = [END, f"a {END} b", f"{END} at the front", f"at the back {END}", f"twice{END}{END}over", f"{END[:-1]} cut", f"é{END}é" * 300, "plain"]


def folded(doc_id, folds=5, before=""):
    return zlib.crc32((before + ("" if doc_id is None else str(doc_id))).encode()) % folds


# Token ids


def test_ids_are_those_of_the_unaltered_tokenizer(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_vocabulary())
    told = lambda t: own.encode(t, add_special_tokens=False).ids if t else []
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + MARKED + [None, ""]
    for text in texts:
        assert tokens.token_ids(text, tokens.default_vocabulary(), added=True).tolist() == told(text)
    assert tokens.token_ids(f"a {END} b", tokens.default_vocabulary(), added=True).tolist().count(own.token_to_id(END)) == 1
    df = spark.createDataFrame(list(enumerate([*MARKED, None, ""])), "doc_id long, text string")
    pieces = packing.pack(df, window=16, with_ids=True, added=True).collect()
    found = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        found[p.doc_id] += p.ids
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    assert found == {i: told(t) + [1] for i, t in enumerate([*MARKED, None, ""])}
    lengths = token_counts.histogram(df, added=True)
    assert {r.n_tokens: r.n_docs for r in lengths.collect()} == Counter(len(told(t)) for t in [*MARKED, None, ""])


@pytest.mark.parametrize("name", ["op1_packing", "op10_token_counts"])
def test_the_queries_count_added_tokens(spark, tmp_path, name):
    df = spark.createDataFrame([(1, f"a {END} b")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.QUERIES[name](spark, str(tmp_path)).first()
    assert (row.doc_tokens if name == "op1_packing" else row.n_tokens + 1) == 5


# Language model


def plain_model(docs, order, tune_folds=8, rounds=60):
    """Scores by deleted interpolation over plain dictionaries, the mixture fitted to every event as it is."""
    words = lambda t: [w.decode("utf-8", "replace") for w in (t or "").encode().lower().split()] + ["<end>"]
    kind = lambda i: "held" if folded(i) == 1 else "tune" if folded(i, tune_folds, "tune") == 0 else "base"

    def counted(kinds):
        grams, n_docs = Counter(), 0
        for i, t in docs:
            if kind(i) in kinds:
                n_docs += 1
                own = ["<begin>"] * order + words(t)
                for at in range(order, len(own)):
                    for n in range(1, order + 1):
                        grams[tuple(own[at - n + 1 : at + 1])] += 1
        return grams, n_docs, sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def events(t, counts):
        """For each token: the bucket and the estimates of the orders 0 to order."""
        grams, n_docs, total, distinct = counts
        own = ["<begin>"] * order + words(t)
        for at in range(order, len(own)):
            p, bucket = [1 / (distinct + 1), grams[(own[at],)] / total if total else 0.0], 0
            for n in range(2, order + 1):
                before = tuple(own[at - n + 1 : at])
                # at the begin of a text the context is the begin itself, as often as there are texts
                context = n_docs if own[at - 1] == "<begin>" else grams[before]
                p.append(grams[(*before, own[at])] / context if context else 0.0)
                if context:
                    bucket = (n - 2) * ngram_lm.BUCKETS + 1 + min(int(math.log2(context)), ngram_lm.BUCKETS - 2)
            yield bucket, p

    base = counted({"base"})
    by_bucket = defaultdict(list)
    for i, t in docs:
        if kind(i) == "tune":
            for bucket, p in events(t, base):
                by_bucket[bucket].append(p)
    weights = {}
    for b in range((order - 1) * ngram_lm.BUCKETS + 1):
        seen = min(order, 1 if b == 0 else 2 + (b - 1) // ngram_lm.BUCKETS)
        w = np.array([1 / (seen + 1)] * (seen + 1) + [0.0] * (order - seen))
        p = np.array([*by_bucket[b], [1.0] + [0.0] * order])
        for _ in range(rounds):
            share = p * w
            w = (share / share.sum(1, keepdims=True)).sum(0) / len(p)
        weights[b] = w
    every = counted({"base", "tune"})
    return [sum(math.log10(float(weights[b] @ np.array(p))) for b, p in events(t, every)) for _, t in docs]


@pytest.mark.parametrize("order,a_token", [(2, 0.001), (3, 0.03)])
def test_lm_scores_against_a_plain_model(spark, order, a_token):
    """The fit sees log ratios to a quarter octave; scores agree with the plain ones within 1 % and this much a token (order 3: where weights are nearly one)."""
    docs = [(r.doc_id, r.text[:3000] if r.text else r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    docs += [(9001, None), (9002, ""), (9003, "The end the END the"), (9003, "The end the END the"), (9004, "rare " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held_out", common.fold(common.F.col("doc_id")) == 1)
    found = ngram_lm.scored(df, order=order, block_tokens=4000, chars_per_bucket=30_000).collect()
    key = lambda i, n, s: (i, n, s)
    have = sorted(key(r.doc_id, r.n_tokens, r.score) for r in found)
    want = sorted(key(i, len((t or "").split()) + 1, s) for (i, t), s in zip(docs, plain_model(docs, order), strict=True))
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert all(a[2] == pytest.approx(b[2], rel=0.01, abs=a_token * b[1]) for a, b in zip(have, want, strict=True))


def test_lm_counts_beyond_32_bits(spark):
    """Totals of more than 2^32 come back whole."""
    hashes, most = np.array([3, 1 << 40, 1 << 63], np.uint64), 0xFFFFFFFF
    row = lambda block, counts: (block, 0, 3, bytearray(ngram_lm.packed_hashes(hashes)), bytearray(ngram_lm.squeezed(np.array([counts, [1, 2, most], [1, 1, 0]], "<u4"))))
    asks = spark.createDataFrame([row(2, [most, 5, 0]), row(4, [most, 6, most])], "block long, bucket int, n long, hashes binary, counts binary")
    for r in ngram_lm.answered(asks).collect():
        assert ngram_lm.unplaned(r.reply, "<u8").reshape(2, -1).tolist() == [[2 * most, 11, most], [2, 4, 2 * most]]


# Language identification


def plain_language(text, dictionaries, piece=1000, least=3000, level=3):
    plain = regex.sub(r"(?:(?!\p{M})[\W\d_])+", " ", (text or "").lower()).split()
    plain = [w for i, w in enumerate(plain) if not i or w != plain[i - 1]]
    if not any(map(str.isalpha, " ".join(plain))) or not dictionaries:
        return "und"
    whole = " ".join(plain).encode()
    if len(whole) >= least:
        turns = [whole]
    else:
        n = min(len(plain), math.ceil(least / len(whole)))
        at = [len(" ".join(plain[:k]).encode()) + (k > 0) for k in (j * len(plain) // n for j in range(n))]
        turns = [whole[i:] + b" " + whole[:i] for i in at]
    parts = []
    for turn in turns:
        own = b""
        for k, w in enumerate(turn.split(b" ")):
            w = (b" " if k else b"") + w
            if own and len(own) + len(w) > piece:
                parts.append(own)
                own = b""
            own += w
            while len(own) > piece:
                cut = max(n for n in range(piece - 3, piece + 1) if own[n] & 0xC0 != 0x80)
                parts.append(own[:cut])
                own = own[cut:]
        parts.append(own)
    best = None
    for name, content in dictionaries.items():
        made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        size = sum(len(made.compress(p)) for p in parts)
        if best is None or size < best[0]:
            best = (size, name)
    return best[1]


def test_language_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language_id.learn(docs)
    texts = [r.text for r in docs.limit(80).collect()] + [None, "", "12 !", "x", "a b c", "le la le la", "é" * 5000, "wort " * 3 + "ü" * 2500 + " ende", " ".join(f"w{i}ord der die" for i in range(40_000))]
    texts += [t[:n] for t in texts[:3] for n in (298, 299, 300, 301, 302, 999, 1001, 2999, 3001)]
    found = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: plain_language(t, learned) for i, t in enumerate(texts)}


def test_combining_marks_are_letters():
    assert language_id.letters("हिन्दी भाषा, 12") == "हिन्दी भाषा".encode() and language_id.letters("é̱a 3b") == "é̱a b".encode()
    assert language_id.pieces("aé é".encode(), 2) == [b"a", "é".encode(), b" ", "é".encode()]
    for text in ("one two three four five", "x" * 50, "ü" * 33):
        for piece in (4, 7, 100):
            assert b"".join(language_id.pieces(text.encode(), piece)) == text.encode()


def test_long_labelled_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{w}{j % 97}x{w}" for j in range(9000)), w) for i, w in enumerate(["aa", "bb"])], "doc_id long, text string, lang string")
    learned = language_id.learn(docs, longest=2000)
    assert sorted(learned) == ["aa", "bb"] and all(1000 < len(x) <= 2000 for x in learned.values())
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j) % 50} {'vile' if i % 2 and j % 3 == 0 else 'fine'} t{j * i % 41}" for j in range(3000))) for i in range(200)], "doc_id long, text string")
    assert b"viie" in toxicity.learn(texts, labels, longest=1000).weights


def test_a_sample_is_bounded_by_distinct_rows(spark):
    """Copies of one row, and ids with many texts, take no place from the others; small labels come whole."""
    rows = [("a", 1, "same")] * 5000 + [("a", i, f"t{i}") for i in range(3000)] + [("b", 7, f"x{i}") for i in range(2000)] + [("c", None, "z"), (None, 5, "n")] + [("d", i, "d") for i in range(90)]
    df = spark.createDataFrame(rows, "kind string, id long, text string").repartition(5)
    found = Counter(r.kind for r in common.bounded_sample(df, "kind", ["id", "text"], 100).collect())
    assert set(found) == {"a", "b", "c", "d"} and found["c"] == 1 and found["d"] == 90 and all(80 <= found[k] <= 180 for k in "ab")
    again = common.bounded_sample(df.repartition(3), "kind", ["id", "text"], 100)
    assert again.exceptAll(common.bounded_sample(df, "kind", ["id", "text"], 100)).count() == 0
    assert common.bounded_sample(df.where("false"), "kind", ["id"], 100).count() == 0


# Toxicity


def plain_measure(words, lexicon):
    """Every word against every pattern, every phrase at every place."""
    exempt = set()
    for i in range(len(words)):
        for phrase in lexicon.exceptions:
            own = phrase.split()
            if words[i : i + len(own)] == own:
                exempt |= set(range(i, i + len(own)))
    total = 0.0
    for i, w in enumerate(words):
        fits = [x for p, x in lexicon.weights.items() if (p.endswith(b"*") and len(w) > len(p) - 1 and w.startswith(p[:-1])) or w == p]
        total += max(fits, default=0.0) if i not in exempt else 0.0
    return (math.log1p(total), math.log1p(100 * total / len(words))) if words else (0.0, 0.0)


def test_toxicity_against_plain_matching(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels, least_texts=3)
    assert lexicon.weights
    mine = toxicity.Lexicon({b"ab": 1.0, b"abc*": 2.0, b"abcd": 0.5, b"x": 3.0}, (b"x ab", b"ab x", b"abcd abcd"), lexicon.curve)
    rng = np.random.default_rng(1)
    texts = [r.text for r in docs.limit(150).collect()] + [None, "", "..", "x"] + [" ".join(rng.choice(["ab", "abc", "abcd", "abcde", "x", "xab", "y"], n)) for n in (1, 2, 5, 30, 30, 30, 400)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(0, texts[0])]  # ids that repeat with other texts, and one row again
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for one in (lexicon, mine):
        made = toxicity.automaton(one.key())
        for t in texts:
            words = toxicity.folded(t)
            assert toxicity.measured(words, made) == pytest.approx(plain_measure(words, one))
        a, b, c = one.curve
        want = [(i, t, round(1 / (1 + math.exp(-(a * x + b * y + c))), 9)) for i, t in rows for x, y in [plain_measure(toxicity.folded(t), one)]]
        assert Counter((r.doc_id, r.text, round(r.score, 9)) for r in toxicity.score(df, one).collect()) == Counter(want)


def test_a_very_long_toxic_text_takes_linear_time():
    made = toxicity.automaton(toxicity.Lexicon({b"ab": 1.0}, (b"x ab",)).key())
    words = [b"ab", b"x", b"ab"] * 200_000
    began = time.perf_counter()
    assert toxicity.measured(words, made)[0] == pytest.approx(math.log1p(200_000))
    assert time.perf_counter() - began < 20
