"""Corpus pipeline: toxic documents out, one of each near-duplicate group, secrets masked, sources mixed, texts encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, mixing, parity_join, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half; the model is fitted on the labelled documents of ``sf_dir``.

    A null or empty text is scored as one without words; rows that repeat stay or go together; an empty table stays
    empty; other columns, whatever their names, come along.
    """
    model = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    name = "toxicity"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one of smallest id, rows without an id last; of an id's the first by its text's
    hash. Rows are linked by their texts, whatever their ids; those without words, null texts too, stay. An empty table
    stays empty; other columns, whatever their names, come along."""
    base, _, roots = parity_join.jaccard_join(docs)
    rows = base.filter("n > 0").select("sig", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at").alias("row"))
    least = rows.groupBy("sig").agg(F.min("row").alias("least"))
    rooted = least.join(roots.toDF("sig", "root").hint("merge"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    first = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")).hint("merge"), "root").select("sig", "first")
    gone = rows.join(first.hint("merge"), "sig").filter("row <> first").select("row.doc_id", "row.at").distinct()
    again = rows.groupBy("row").count().filter("count > 1").select("row.doc_id", "row.at")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("doc_id").cast("long").alias("id"), common.text_key().alias("hash"))
    same = lambda keys: F.col("id").eqNullSafe(keys["doc_id"]) & (F.col("hash") == keys["at"])
    out = keyed.join(gone.hint("merge"), same(gone), "left_anti")
    if not again.isEmpty():  # equal rows, of which one stays
        again = again.distinct()
        out = out.join(again.hint("merge"), same(again), "left_anti").unionByName(out.join(again.hint("merge"), same(again), "left_semi").dropDuplicates(["id", "hash"]))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in names])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes [SECRET]; n_chars, where there is one, follows the text. No document is dropped.

    Null texts stay null, their n_chars is left alone; rows that repeat stay; an empty table stays empty; other columns,
    whatever their names, come along.
    """
    out = secrets.masked(docs)
    kinds = dict(docs.dtypes)
    size = F.when(F.col("text").isNotNull(), F.char_length("text").cast(kinds["n_chars"])).otherwise(F.col("n_chars")) if "n_chars" in kinds else None
    return out if size is None else out.withColumn("n_chars", size)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice: words taken over size, rounded half up.

    A document without words, null texts too, isn't taken; a null source is one more source; rows that repeat share their copies
    evenly; an empty table stays empty; other columns, whatever their names, come along.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every document left; a null text has no ids and decodes to an empty one; rows
    that repeat and null ids stay; other columns don't come along; an empty table gives an empty one."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_group),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Training and approximate candidate search have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, "stage")
    return docs
