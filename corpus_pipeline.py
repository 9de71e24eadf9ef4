"""A corpus pipeline: language ID, toxicity, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared
folder and read again as the next stage's docs. All stages but the last return the columns of documents, as they
came, whatever they are called (docs needs doc_id and text, and lang to learn languages from).

Rows are judged one by one, not by doc_id: of two texts under one id each has its own decision, and rows without an
id are documents too. Null and empty texts and texts without letters are rejected by the language stage, for no
language can be told; a stage that gets them nevertheless keeps them. Texts of any length are read whole. Rows that
repeat go with the near duplicates. An empty table passes through every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirlog.llm import common, decontamination, jaccard_join, language_id, packing, toxicity


def apart(docs: DataFrame) -> DataFrame:
    """docs with names for the other columns that no operator uses."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)))


def back(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of apart(docs) as docs had them."""
    return kept.select(*apart(docs).columns).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; what has no letters or fits two languages alike goes."""
    return back(language_id.identify(apart(docs), language_id.learn(docs)).where(~F.col("rejected")), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; all of them, if there are no labels of both kinds."""
    learned = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score(apart(docs), learned).where(F.col("score") < 0.5), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: of the smallest doc_id (without one, if no member has any), then of the smallest text key.

    Of rows with equal id and text one stays, by a hash of the other columns. Texts without words have no links and stay, repeated rows with an id once.
    """
    plain = apart(docs)
    told = [f.name for f in plain.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]  # what has a hash
    ids = lambda df: df.withColumns({"_no_id": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))})
    keyed = ids(plain).withColumns({"_h0": decontamination.text_key()["h0"], "_h1": decontamination.text_key()["h1"]})
    key = ["_no_id", "_id", "_h0", "_h1"]
    once = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*told)))).where(F.col("_rank") == 1)
    first = ids(jaccard_join.firsts(plain)).select("_no_id", "_id", F.col("h0").alias("_h0"), F.col("h1").alias("_h1"))
    wordless = plain.where(F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(common.WORD))
    return back(once.join(first, key, "left_semi").select(*plain.columns).union(wordless), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    plain = apart(docs)
    found = decontamination.contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("items") > 0).select("doc_id", "text_key").distinct()
    keyed = plain.withColumn("_key", decontamination.text_key())
    return back(keyed.join(hit, keyed["doc_id"].eqNullSafe(hit["doc_id"]) & (keyed["_key"] == hit["text_key"]), "left_anti"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences."""
    return packing.pack(docs, added=True)


STAGES = [("language_id", language), ("toxicity", toxic), ("jaccard_join", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: Language identification has no SQL; the stages are held against plain versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{name}")
    return docs
