"""Markup and differencing of odd pages; pipeline stages with clashing names, repeats, long texts and empty tables."""

from collections import Counter, namedtuple

import numpy as np
import pytest

from weirlog.llm import decontamination, html_text

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a</p><svg/><p>b</p>", ["a", "b"]),
        ("<p>x</p><button/><p>after</p>", ["x", "after"]),
        ("<p>a</p><svg><title>pic</title><path d='M0'/></svg><select><option>1</select><p>b", ["a", "b"]),
        ("<div class='layout has-sidebar'><p>story</p></div>", ["story"]),
        ("<div class='side-by-side'>s</div><p class='notice-of-death'>n</p><div class='related'>r</div>", ["s", "n", "r"]),
        ("<div class='cookieNotice'>c</div><div id=main_nav>m</div><div class='post-comments'>p</div><div role=search>q</div><div class=ad-1>d</div>z", ["z"]),
        ("<p>x <math>a+b</math> <canvas>y</canvas></p>", ["x a+b y"]),
        ("<p><a href=1>all of this</a> <a href=2>is links</a></p>", ["all of this is links"]),
        ("<script>if (a<b) '<p>no</p>'", []),
        ("t<script src=x></script>u<style>p{}</style>", ["t u"]),
        ("<div><aside>open<p>x</div><p>story", ["story"]),
        ("<ul><li class=ad>x<li>y</ul>", ["y"]),
        ("<" * 50_000, ["<" * 50_000]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
    ],
)
def test_open_lines(page, want):
    assert html_text.lines_of(page) == (want, False)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<aside><article class='card'>teaser</article></aside><article>real</article>", ["real"]),
        ("<article>real<section class='comments'><article class='post'>one</article><article>two</article></section> on</article>", ["real", "on"]),
        ("<body><nav>never closed<main>kept</main></body>", ["kept"]),
        ("<form id=all><main><p>in a form</main></form>", ["in a form"]),
        ("<main><header><h1>T</h1></header>x<form>f</form></main><footer>c</footer>", ["T", "x"]),
    ],
)
def test_articles(page, want):
    assert html_text.lines_of(page) == (want, True)


def test_long_subsequences_in_linear_space():
    draw = np.random.default_rng(3)
    for _ in range(60):
        a, b = ([str(x) for x in draw.integers(0, 5, draw.integers(0, 14))] for _ in range(2))
        whole, halves = html_text.shared(a, b), html_text.shared(a, b, cells=0)
        assert len(whole) == len(halves)
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(halves))
    lines = [str(i) for i in range(60_000)]
    assert html_text.shared(lines[:30_000] + ["x"] + lines[30_000:], ["y", *lines, "z"]) == {*range(30_000), *range(30_001, 60_001)}


PAGE = "<p>Site name<p>Article {0} says something of its own, at some length<p>All rights reserved"


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_repeated_urls_copies_and_articles(spark, parts):
    """Pages of one URL given twice, runs of equal pages over several ranges, an article beside open lines, a copy on one side."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        pages = [(i, f"http://h.org/a/{i // 2}", PAGE.format(i // 2)) for i in range(8)]  # every page twice
        pages += [(100 + i, f"http://run.org/{i:03d}", PAGE.format("R")) for i in range(40)] + [(90, "http://run.org/0", PAGE.format("first")), (190, "http://run.org/z", PAGE.format("last"))]
        pages += [(200, "http://m.org/a", "<p>Top<p>A body beside its small teaser, which is not the text<article>teaser</article><p>Foot"), (201, "http://m.org/b", "<p>Top<article>An article that is longer than what stands around it</article><p>Foot<p>by me")]
        pages += [(300, "http://c.org/x1", PAGE.format("copied")), (301, "http://c.org/x2", PAGE.format("copied") + "<p>y"), (302, "http://c.org/z", PAGE.format("other"))]
        df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS part", "2 AS lines")
        found = {r.page_id: r.text for r in html_text.extracted(df.repartition(4)).collect()}
        assert sorted(found) == sorted(p[0] for p in pages)
        own = "Article {0} says something of its own, at some length".format
        for i in range(8):
            assert found[i] == own(i // 2)
        assert {found[100 + i] for i in range(40)} == {own("R")} and found[90] == own("first") and found[190] == own("last")
        assert found[200] == "A body beside its small teaser, which is not the text\n\nteaser"
        assert found[201] == "An article that is longer than what stands around it"
        assert found[302] == own("other") and own("copied") in found[300] and found[301] == own("copied") + "\n\ny"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_where_content_beyond_a_range_is():
    run = namedtuple("run", "part side mark")
    runs = [run(0, "first", "a"), run(0, "last", "b"), run(1, "only", "b"), run(3, "first", "b"), run(3, "last", "c"), run(4, "only", "d")]
    found = {(p, s, w): rest for p, s, w, *rest in html_text.outside(runs)}
    assert found == {
        (1, "only", "before"): [0, "last", "before"],
        (3, "first", "before"): [0, "last", "before"],
        (4, "only", "before"): [3, "last", "own"],
        (3, "last", "after"): [4, "only", "own"],
        (1, "only", "after"): [3, "first", "after"],
        (0, "last", "after"): [3, "first", "after"],
    }


CLASH = ["lang", "score", "lang_pred", "margin", "rejected", "_rank", "_key", "_h0", "_id", "_drawn", "words", "n_words", "set_id", "copies"]


def test_stages_give_columns_back(spark):
    """Columns of any name and type come through every stage as they were; repeats, long and empty texts, no ids."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    some = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    odd = [(9001, None, "en"), (9002, "", "en"), (None, "12 34", None), (9003, f"the {item} of it", "en"), (9004, "the of and to " * 20_000, "en"), (9005, "the cat and the dog of the house", "en"), (9005, "the cat and the dog of the house", "en"), (9005, "a second text of the same id that stands alone", "en")]
    docs = some.union(spark.createDataFrame(odd, some.schema))
    docs = docs.selectExpr("doc_id", "text", "lang", *(f"concat('{c} ', coalesce(doc_id, 0)) AS {c}" for c in CLASH[1:]), "map('a', doc_id) AS tags")
    sound = lambda r: all(r[c] == f"{c} {r.doc_id or 0}" for c in CLASH[1:]) and r.tags == {"a": r.doc_id}
    kept = docs
    for name in list(stages)[:-1]:
        kept = pipeline.common.materialise(stages[name](spark, kept, SF), "t")
        assert kept.schema.names == docs.schema.names
        rows = kept.collect()
        assert rows and all(sound(r) for r in rows)
    texts = Counter((r.doc_id, r.text) for r in rows)
    assert not {9001, 9002, 9003} & {i for i, _ in texts}
    assert texts[9005, odd[5][1]] == 1 and texts[9005, odd[7][1]] == 1
    plain = decontamination.contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert plain.where("size(items) > 0").count() == 0
    pieces = stages["packing"](spark, kept, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {i for i, _ in texts}


def test_empty_tables_pass_through(spark, tmp_path):
    """No documents, and documents without labels or benchmark items."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    stages = dict(pipeline.STAGES)
    few = docs.where("length(text) < 2000").limit(10)
    for name in ("toxicity", "decontamination"):
        assert stages[name](spark, few, str(tmp_path)).count() == few.count()
    assert stages["language_id"](spark, few.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"), str(tmp_path)).count() == 0
