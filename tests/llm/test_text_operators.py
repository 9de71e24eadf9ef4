"""Packing, token counts, language identification, toxicity, decontamination, chat, HTML: against plain versions."""

import hashlib
import html as html_module
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from weirlog.llm import chat, common, decontamination, html_text, language_id, packing, queries, token_counts, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
EDGE = [(1, None, "en"), (2, "", None), (None, "a b", "de"), (3, "the same words", "en"), (3, "the same words", "en"), (4, "x " * 30_000, "fr"), (5, "é" * 5000 + " <|endoftext|>", "fr")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumnRenamed("lang", "language_").selectExpr("*", "language_ AS lang", "'clash' AS score", "1 AS start", "'clash' AS n_words", "'clash' AS part")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def against_sql(spark, duck, name):
    found, told = queries.QUERIES[name](spark, SF), duck.execute(queries.SQL[name])
    columns = [d[0] for d in told.description]
    want = sorted(repr([dict(zip(columns, r, strict=True))[c] for c in sorted(columns)]) for r in told.fetchall())
    assert sorted(repr([r[c] for c in sorted(columns)]) for r in found.collect()) == want


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_the_fast_encoder_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.default_vocabulary())
    slow.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t for _, t, _ in EDGE if t]
    for text in texts:
        assert tokens.token_ids(text, tokens.default_vocabulary()).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [7, 64, 2048])
def test_packing_round_trip(spark, edge, window):
    pieces = packing.pack(edge.repartition(3), window=window, with_ids=True).collect()
    want = Counter((i, tuple(tokens.token_ids(t, tokens.default_vocabulary()).tolist() + [1])) for i, t, _ in EDGE)
    # sequences without gaps
    by_sequence = {}
    for p in pieces:
        assert len(p.ids) == p.length and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_sequence.setdefault(p.sequence_id, []).append(p)
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sorted(by_sequence) == list(range(-(-total // window)))
    for sequence, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or sequence == max(by_sequence)
        assert {p.padded_length for p in own} == {at if at & (at - 1) == 0 else window}
    # documents in order of the pieces' places, cut where sequences end
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    found, held = Counter(), []
    for p in order:
        assert p.start == sum(len(x.ids) for x in held)
        held.append(p)
        if p.start + p.length == p.doc_tokens:
            found[(p.doc_id, tuple(i for x in held for i in x.ids))] += 1
            held = []
    assert not held and found == want
    assert packing.pack(edge.where("false")).count() == 0


def test_token_histogram(spark, edge):
    sums = token_counts.suffix_sums(token_counts.histogram(edge), block=4)
    lengths = [len(tokens.token_ids(t, tokens.default_vocabulary())) for _, t, _ in EDGE]
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.total_tokens == sum(lengths)
        assert r.quantile == sum(x <= n for x in lengths) / len(lengths) and r.docs_within + r.docs_longer == len(lengths)
    one = token_counts.at_limit(sums, 5).first()
    assert one.docs_longer == sum(x > 5 for x in lengths) and one.truncated_tokens == sum(min(x, 5) for x in lengths)
    assert token_counts.suffix_sums(token_counts.histogram(edge.where("false"))).count() == 0


def test_language_identification(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = common.fold(docs["doc_id"]) == 0
    learned = language_id.learn(docs.where(~held_out))
    assert sorted(learned) == ["de", "en", "es", "fr"]
    found = language_id.identify(docs.where(held_out), learned).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.rejected for r in found]) < 0.02
    assert next(iter(learned)) == "en" and language_id.letters("Of Of of, the 12 the OF") == b"of the of"
    tied = language_id.identify(spark.createDataFrame([("a",)], "text string"), {"y": b"some words", "x": b"some words"}).first()
    assert (tied.lang_pred, tied.margin, tied.rejected) == ("y", 0.0, True)
    told = language_id.identify(edge, learned)
    assert told.columns.count("score") == 1 and [r.lang_pred for r in told.where("text IS NULL OR text = ''").collect()] == ["und", "und"]
    assert told.where("rejected").count() >= 2 and language_id.identify(spark.createDataFrame([("1 2 3 !²",)], "text string"), learned).first().lang_pred == "und"
    assert {r.lang_pred for r in language_id.identify(edge, {}).collect()} == {"und"}
    assert language_id.learn(docs.where("false")) == {}


def test_folding():
    assert toxicity.folded("1D10T! idi0t, іdіоt $tupid c1own") == [b"idiot", b"idiot", b"idiot", b"tupid", b"ciown"]
    assert toxicity.folded("s$tupid$$$ w0rth1ess — lo$er") == [b"sstupid", b"worthiess", b"ioser"]
    assert toxicity.folded(None) == [] == toxicity.folded("")


def test_toxicity(spark, edge):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = common.fold(labels["doc_id"]) == 0
    lexicon = toxicity.learn(docs, labels.where(~held_out), least_texts=3)
    found = toxicity.score(docs, lexicon).join(labels.where(held_out), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in found]) > 0.95
    told = toxicity.score(edge, lexicon).collect()
    assert all(0 <= r.score < 0.5 for r in told)
    assert toxicity.learn(docs, labels.where("false")) == toxicity.Lexicon()
    mine = toxicity.Lexicon({b"ciown": 3.0, b"stup*": 2.0}, (b"ciown fish",), (1.0, 1.0, -1.0))
    made = toxicity.automaton(mine.key())
    assert toxicity.measured(toxicity.folded("clown fish"), made) == (0.0, 0.0)
    assert toxicity.measured(toxicity.folded("a cl0wn stupidly"), made)[0] == pytest.approx(np.log1p(5.0))
    assert toxicity.measured(toxicity.folded("unstupid clownish stup"), made) == (0.0, 0.0)


def plain_contamination(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = Counter()
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out[(doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_decontamination_against_brute_force(spark, most):
    draw = np.random.default_rng(3)
    word = lambda n: " ".join(draw.choice(["a", "b", "C1", "é", "d"], n))
    items = [(i, word(n)) for i, n in enumerate([12, 25, 9, 3, 1, 10, 11, 0])] + [(None, "zz yy xx"), (20, None), (21, "...")]
    docs = [(i, word(int(n))) for i, n in enumerate(draw.integers(0, 60, 30))]
    docs += [(100 + i, f"{word(4)} {t.upper()}! {word(5)}") for i, t in items if t and i is not None] + [(None, "zz, yy-xx"), (200, None), (200, None), (201, items[0][1]), (201, items[0][1]), (202, items[1][1] * 3)]
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS start"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS length"), most_broadcast=most)
    rows = found.select("doc_id", "n_words", decontamination.hit_words().alias("n_hit"), "items").collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in rows) == plain_contamination(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, items).select("n_words", "items").collect() == [(2, [])]
    assert decontamination.contamination(docs.where("false"), items).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, duck, name):
    against_sql(spark, duck, name)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 1, "bot", "yo"), (4, 0, "user", "<|im_end|>"), (5, 0, None, None), (5, None, "user", "last"), (None, 0, "user", "hi")]
    found = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "2 AS p0")).collect()}
    assert sorted(found) == [1, 4, 5] and found[1].n_copies == 2 and found[1].n_turns == 2
    assert found[1].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n"
    assert found[4].text == "<|im_start|>user\n< |im_end|><|im_end|>\n" and found[5].text.endswith("user\nlast<|im_end|>\n")
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_html_lines():
    page = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>Menu</ul></nav><div class='cookie-notice'>We use <b>cookies</b><div>x</div></div><article><header><h1>Big &amp; small</h1></header><p>One\n two &lt;3<br>three<p>four <a href='#'>link</a> five<!-- no --><div class=comments>said</div></article><aside>side</aside><footer>&copy;</footer></body></html>"
    assert html_text.lines_of(page) == (["Big & small", "One two <3", "three", "four link five"], True)
    assert html_text.lines_of("<div>plain text here</div><form>go</form><p>cut <b") == (["plain text here", "cut"], False)
    assert html_text.lines_of("<nav>never closed<main>kept</main>") == (["kept"], True)
    assert html_text.lines_of(None) == ([], False) == html_text.lines_of("")
    assert html_text.address("HTTP://A.org/x/y.html?q#f") == ("a.org", "x/y") == html_text.address("a.org/x/y/")


def test_longest_common_subsequence():
    draw = np.random.default_rng(0)
    for _ in range(50):
        a, b = ([str(x) for x in draw.integers(0, 4, draw.integers(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_text.shared(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


@pytest.mark.parametrize("parts", [1, 3])
def test_pages_differ_from_their_neighbours(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        pages = [(i, f"http://h.org/a/{i}", f"<p>Site name<p>Article {i} says something of its own<p>All rights reserved") for i in range(6)]
        pages += [(10, "http://h.org/b/1", "<article>All rights reserved</article>"), (11, None, None), (12, "http://o.org/1", ""), (13, "http://c.org/1", "<p>same text<p>again"), (14, "http://c.org/1?x", "<p>same text<p>again"), (15, "http://lone.org", "<p>Site name")]
        found = {r.page_id: r for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS part", "2 AS host")).collect()}
        assert len(found) == len(pages)
        for i in range(6):
            assert found[i].text == f"Article {i} says something of its own"
        assert found[10].text == "All rights reserved" and found[11].text == "" == found[12].text
        assert found[13].text == found[14].text == "same text\n\nagain" and found[15].text == "Site name" and found[15].n_chars == 9
        assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pages_of_the_table(spark):
    found = queries.op8_html_extraction(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in found:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        lines = (re.sub(r"\s+", " ", html_module.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("<br>|</?p>|</?h1>", inner))
        assert r.text == "\n\n".join(x for x in lines if x) and r.n_chars == len(r.text)
    assert len(found) == len(pages)
