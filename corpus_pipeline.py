"""From documents to packed training sequences: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. All but the last return the columns of
documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm.common import parts, prepared, table
from sceneql.llm.op03_toxicity import with_score
from sceneql.llm.op04_substrings import remove_repeats
from sceneql.llm.op05_mixing import WORD, mix
from sceneql.llm.op08_packing import pack
from sceneql.llm.op09_minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prepared_docs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents alone, so that no other column's name can clash."""
    prepared(spark)
    return docs.select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject, unchanged."""
    docs = prepared_docs(spark, docs)
    return with_score(docs, table(spark, sf_dir, "labels"), "toxicity").where("toxicity < 0.5").select(COLUMNS)


def shared(rows: DataFrame) -> bool:
    """Whether two of the rows have one id."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count() > 0


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number for each row that ascends by id, then by text; nulls are first."""
    placed = docs.repartitionByRange(parts(docs.sparkSession), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return placed.withColumn("_row", F.monotonically_increasing_id()).checkpoint()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, unchanged; of rows with one id and text, one.

    Rows that share an id but not a text are documents of their own, in the order of their texts. A null id is kept.
    """
    docs = prepared_docs(spark, docs)
    named = docs.where("doc_id is not null")
    once = named.repartition("doc_id").dropDuplicates(["doc_id", "text"])
    if shared(named.select("doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y")).distinct()):
        rows = numbered(once)
        gone = near_duplicates(rows, "_row").where("not kept").select(F.col("doc_id").alias("_row"))
        left = rows.join(gone.hint("merge"), "_row", "left_anti")
    else:
        gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
        left = once.join(gone.hint("merge"), "doc_id", "left_anti")
    return left.select(COLUMNS).unionByName(docs.where("doc_id is null"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document has; those of which nothing is left go."""
    docs = prepared_docs(spark, docs)
    own = "doc_id"
    if shared(docs.where("doc_id is not null")):
        docs, own = numbered(docs).withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.col("_row"))), "_row"
    cut = remove_repeats(docs, own).where("n_removed > 0").select(F.col("doc_id").alias("_id"), "n_words", "n_removed", "kept_text")
    # a left join by what tells rows apart: null ids lose nothing, so they have no row in cut
    joined = docs.join(cut, F.col(own) == F.col("_id"), "left").where("_id is null or n_removed < n_words")
    text = F.when(F.col("_id").isNotNull(), F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("_id").isNotNull(), F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes a document; the last one of a source may be the beginning of a document."""
    docs = prepared_docs(spark, docs)
    own = None
    if shared(docs):
        docs, own = numbered(docs), "_row"
    taken = mix(docs, row_col=own).where("taken > 0").select(F.col(own or "doc_id").alias("_id"), "size", "taken")
    joined = docs.join(taken, F.col(own or "doc_id").eqNullSafe(F.col("_id")))
    whole = F.expr("cast(taken div size as int)")
    rest = F.expr("cast(taken % size as int)")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = joined.select("*", F.explode(copies).alias("_words"))
    begin = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col("_words"), F.lit(1))), " ")
    text = F.when(F.col("_words") > 0, begin).otherwise(F.col("text"))
    chars = F.when(F.col("_words") > 0, F.char_length(begin).cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substrings", drop_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, training and evolution have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    prepared(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    raise AssertionError("no stages")
