"""Language model scoring, nearest neighbours, the Jaccard join and the pipeline: against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from weirlog.llm import ann, common, decontamination, jaccard_join, ngram_lm, queries

SF = "/root/testdata/sf0.001"


def folded(doc_id, folds=5, before=""):
    return zlib.crc32((before + ("" if doc_id is None else str(doc_id))).encode()) % folds


def test_folds(spark):
    rows = [(i,) for i in [*range(50), None]]
    df = spark.createDataFrame(rows, "doc_id long")
    assert [r.f for r in df.select(common.fold(df["doc_id"]).alias("f")).collect()] == [folded(i) for (i,) in rows]


@pytest.mark.parametrize("order", [2, 3])
def test_lm_against_brute_force(spark, order):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, None), (901, ""), (902, "a A a\tb c"), (902, "a A a\tb c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fold", "2 AS score")
    found = ngram_lm.scored(df.withColumn("held_out", common.fold(df["doc_id"]) == 1), order=order, block_tokens=3000, chars_per_bucket=50_000).collect()
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    train = [words(t) for i, t in docs if folded(i) != 1]
    one = Counter(w for d in train for w in d)
    total, distinct = sum(one.values()), len(one)

    def told(i, t):
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words(t))
        return (i, folded(i) == 1, len(words(t)), sum(w in one for w in words(t)), total, round(base, 6))

    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == Counter(told(i, t) for i, t in docs)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in found)
    empty = df.where("false").selectExpr("doc_id", "text", "true AS held_out")
    assert ngram_lm.scored(empty).count() == 0
    unknown = ngram_lm.scored(df.selectExpr("doc_id", "text", "true AS held_out")).collect()
    assert all(r.n_known == 0 and r.score <= 0 for r in unknown)


def test_lm_mixture_is_a_distribution():
    """Over a small vocabulary, the probabilities of all next words add up to one in every context."""
    rng, order = np.random.default_rng(0), 3
    text = rng.integers(0, 5, 400).tolist()
    counts = [Counter(tuple(text[max(0, i - n) : i + 1]) for i in range(len(text))) for n in range(order)]
    weights = ngram_lm.fitted(np.array([[0, 5, -240, -240], [5, 4, 9, -240], [30, 4, 8, 12]], float), np.array([5.0, 7.0, 9.0]), order)
    for a, b in [(0, 1), (4, 4), (2, 0)]:
        grams = np.array([[counts[0][(w,)] for w in range(5)], [counts[1][(b, w)] for w in range(5)], [counts[2][(a, b, w)] for w in range(5)]])
        context = np.array([sum(grams[1]), sum(grams[2])])
        p = np.zeros((order + 1, 6))
        p[0], p[1, :5] = 1 / 6, grams[0] / len(text)
        p[2, :5] = grams[1] / context[0]
        seen = context[1] > 0
        if seen:
            p[3, :5] = grams[2] / context[1]
        bucket = (1 if seen else 0) * ngram_lm.BUCKETS + 1 + int(math.log2(context[1 if seen else 0]))
        assert (weights[bucket] @ p).sum() == pytest.approx(1.0)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 24)).astype(np.float32)
    vectors[700:1100] = vectors[700]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(2000, None, 1), (2100, [0.0] * 24, 1), (2200, [float("nan")] * 24, 1), (2300, [None] * 24, 1), (2400, [1.0], 1), (None, vectors[0].tolist(), 1), (5, vectors[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = ann.nearest(df, df.where("vec_id % 100 == 0"), index_block=300, query_block=5).collect()
    exact, data = {}, vectors.astype(np.float64)
    for q in range(0, 1500, 100):
        d = np.sqrt(np.square(data - data[q]).sum(1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        exact[q] = [(i, d[i]) for i in order]
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by_query) == sorted(exact) and all(len(x) == 10 for x in by_query.values())
    hit = sum(len({i for i, _ in by_query[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hit / (10 * len(exact)) >= 0.9
    assert by_query[700] == [(i, 0.0) for i in range(701, 711)]
    for q, own in by_query.items():
        assert own == sorted(own, key=lambda x: (x[1], x[0])) and all(s == pytest.approx(float(np.linalg.norm(data[i] - data[q]))) for i, s in own)
    assert ann.nearest(df.where("false"), df).count() == 0
    few = df.where("vec_id < 4")
    assert ann.nearest(few, few).count() == 12


@pytest.mark.parametrize("spread", [0.01, 0.0])
def test_isolated_queries_get_their_neighbours(spark, spread, n=1200):
    """Tight clusters (or exact copies) set a small radius; the few vectors far from all others still get k exact rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    vectors = centres[np.arange(n) % 20] + spread * rng.normal(size=(n, 16))
    vectors[::100] = 3 * rng.normal(size=(12, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = [*range(0, n, 50), 7, 8]
    found = {}
    for r in ann.nearest(df, df.where(df["vec_id"].isin(asked)), index_block=500, query_block=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in asked:
        d = np.sqrt(np.square(vectors - vectors[q]).sum(1))
        assert found.get(q) == [i for i in np.lexsort((np.arange(n), d)).tolist() if i != q][:10]


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    index, query = rng.integers(0, 256, (400, 4), np.uint8), rng.integers(0, 256, (20, 4), np.uint8)
    for radius in (0, 1, 5, 9, 12, 32):
        distance = np.bitwise_count(query[:, None] ^ index[None]).sum(2)
        assert (ann.probed(query, ann.Tables.of(index), radius) == (distance <= radius)).all()


def sets_of(docs, n=5):
    out = []
    for _, t in docs:
        w = common.words_of(t)
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute(docs, threshold=0.8):
    sets = sets_of(docs)
    links = [[j for j in range(len(docs)) if j != i and a and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9] for i, a in enumerate(sets)]
    root = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(links):
            for j in own:
                if root[j] > root[i]:
                    root[j], changed = root[i], True
    name = {r: min((docs[i][0] for i in range(len(docs)) if root[i] == r and docs[i][0] is not None), default=None) for r in set(root)}
    return Counter((docs[i][0], name[root[i]] if sets[i] else docs[i][0], len(links[i])) for i in range(len(docs)))


@pytest.mark.parametrize("bucket,block", [(1024, 256), (8, 4)])
def test_jaccard_join_against_brute_force(spark, bucket, block):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    docs, at = [], 0
    for size in (1, 2, 3, 40):
        base = word(80)
        for _ in range(size):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = "edit"
            docs.append((at, " ".join(own)))
            at += 1
    docs += [(at + i, " ".join(word(50))) for i in range(30)]
    docs += [(500, docs[0][1].upper()), (501, docs[0][1]), (501, docs[0][1]), (None, docs[1][1]), (None, "lonely words without any id"), (600, None), (601, ""), (602, "!!"), (603, "one two"), (604, "One, two!"), (605, "w " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS path", "'x' AS set_id", "2 AS label")
    found = jaccard_join.classes(df, bucket=bucket, block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == brute(docs)
    assert jaccard_join.classes(df.where("false")).count() == 0


def test_runs_reach_the_recall():
    runs = jaccard_join.runs_for(0.8, 3, 0.99)
    assert (1 - 0.8**3) ** runs <= 0.01 < (1 - 0.8**3) ** (runs - 1)


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, item = "idiot moron worthless scum clown", spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    first = docs.where("length(text) > 1500").first().text
    planted = [(9001, None, "en", "s", 0), (9002, "12 34 !!", "en", "s", 0), (9003, first, "en", "s", 0), (9004, first + " tail", "en", "s", 0), (9005, f"Thing the tion {item} and the rest of", "en", "s", 0), (None, "der die und das", "de", "s", 0)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "jaccard_join", "decontamination", "packing"] and pipeline.ORACLE_SQL is None and toxic
    kept = common.materialise(stages["language_id"](spark, docs, SF), "t")
    assert kept.columns == docs.columns and {9001, 9002} <= {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()}
    assert kept.count() >= docs.count() - 6
    clean = common.materialise(stages["toxicity"](spark, kept, SF), "t")
    assert clean.columns == docs.columns
    once = common.materialise(stages["jaccard_join"](spark, clean, SF), "t")
    groups = brute([(r.doc_id, r.text) for r in clean.collect()])
    assert Counter(r.doc_id for r in once.collect()) == Counter(i for i, c, _ in groups if i == c)
    rest = common.materialise(stages["decontamination"](spark, once, SF), "t")
    hit = decontamination.contamination(once, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(items) > 0")
    ids = {r.doc_id for r in hit.collect()}
    assert 9005 in ids and {r.doc_id for r in once.collect()} - ids == {r.doc_id for r in rest.collect()}
    packed = stages["packing"](spark, rest, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rest.collect()}
    assert pipeline.run(spark, SF).count() > 0


def test_near_duplicates_keep_one_document_of_each_class(spark):
    """Copies among rows without an id go too; of one id with two texts, each text is judged by its own class."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda n: " ".join(f"{n}x{i}" for i in range(60))
    near = lambda n: text(n).replace("x7 ", "y7 ")
    docs = [(1, text("a")), (None, text("a")), (None, near("a"))]  # goes with an id
    docs += [(None, text("b")), (None, text("b")), (None, near("b"))]  # no id at all: one stays
    docs += [(2, text("c")), (2, text("d"))]  # two clean texts of one id
    docs += [(3, text("e")), (4, text("e")), (4, text("f")), (4, text("f"))]  # a copy of a smaller id beside a clean text
    docs += [(5, text("g")), (5, near("g")), (None, text("h")), (None, None), (None, "!!"), (None, "!!"), (6, "?"), (6, "?"), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _rank0", "'x' AS set_id")
    found = Counter((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, df, SF).collect())
    sure = Counter([(1, text("a")), (2, text("c")), (2, text("d")), (3, text("e")), (4, text("f")), (None, text("h")), (None, None), (None, "!!"), (None, "!!"), (6, "?"), (6, None)])
    assert sure <= found
    left = sorted((i or 0, t[0]) for i, t in (found - sure).elements())
    assert left == [(0, "b"), (5, "g")]
    assert pipeline.near_duplicates(spark, df.where("false"), SF).count() == 0


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
