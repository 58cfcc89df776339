"""Order MinHash fingerprints of texts and of edited texts, in DataFrame functions alone.

A text's k-mers are runs of K words, numbered by occurrence; where words are longer than LONG_WORD characters on average
(unspaced scripts, encoded data), runs of K_CHARS characters. One hash deals them to BINS bins. The smallest k-mer of each
bin and the next smallest, which is the next bin's where a bin has one alone, are kept in the text's order and hashed
together, so that every value tells an order. Two texts' likeness is the share of equal bins among those that either
fills, so it falls with words that are changed and with words that are moved.

K-mers are packed as hash and place into one long, so that arrays sort as numbers: equal k-mers then lie in runs whose
starts give the occurrence numbers, and a bin's smallest are its first. The work grows as n log n with a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneql.llm.common import parts, prepared, table

K, BINS, K_CHARS, LONG_WORD = 3, 64, 8, 32
#: A packed k-mer: 32 bits of hash, the first 6 of them its bin, and 31 bits of place, as many as an array has.
PLACE, BIN, VALUE = 31, 57, 26
SPACES = " \t\n\x0b\x0c\r"


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, PLACE)


def with_fingerprint(d: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """d with out: array<int> of the filled bins in order, 6 bits of bin and 26 of value; empty without words.

    Each helper column is used twice or more by the next one, so the optimizer keeps it apart and computes it once.
    """
    w, a, s, o, b, m = (f"_{out}_{x}" for x in "waosbm")
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    c = f"_{out}_c"
    d = d.withColumn(w, F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn(c, F.char_length(bare) > LONG_WORD * F.size(w))
    d = d.withColumn(w, F.when(F.col(c), F.split(bare, "")).otherwise(F.col(w)))
    size = F.when(F.col(c), K_CHARS).otherwise(k)
    kmers = F.slice(F.col(w), F.lit(1), F.greatest(F.size(w) - (size - 1), F.least(F.size(w), F.lit(1))))
    packed = F.transform(kmers, lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, *(F.get(F.col(w), i + j) for j in range(1, k)), *(F.when(F.col(c), F.get(F.col(w), i + j)) for j in range(k, K_CHARS))), 1 + PLACE), PLACE).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << PLACE) - 1))))
    d = d.withColumn(a, F.sort_array(packed)).drop(w, c)
    n = F.size(a)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn(s, F.filter(index, lambda i: (i == 0) | (_hash(F.get(F.col(a), i)) != _hash(F.get(F.col(a), i - 1)))))
    occurrence = F.flatten(F.zip_with(F.col(s), F.concat(F.slice(s, 2, 1 << 30), F.array(n)), lambda x, y: F.sequence(F.lit(0), y - x - 1)))
    again = F.zip_with(F.col(a), occurrence, lambda x, c: F.when(c == 0, x).otherwise(F.shiftleft(F.shiftrightunsigned(F.xxhash64(_hash(x), c), 1 + PLACE), PLACE).bitwiseOR(x.bitwiseAND(F.lit((1 << PLACE) - 1)))))
    d = d.withColumn(o, F.when(F.size(s) == n, F.col(a)).otherwise(F.sort_array(again))).drop(a, s)
    d = d.withColumn(b, F.filter(F.col(o), lambda x, i: (i < 2) | (F.shiftright(x, BIN) != F.shiftright(F.get(F.col(o), i - 2), BIN)))).drop(o)

    def value(x: Column, i: Column) -> Column:
        y = F.coalesce(F.get(F.col(b), i + 1), F.get(F.col(b), F.lit(0)))
        here = F.shiftright(x, BIN)
        place = (1 << PLACE) - 1
        first = x.bitwiseAND(F.lit(place)) <= y.bitwiseAND(F.lit(place))
        both = F.when(first, F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
        h = F.when(x != y, both).otherwise(F.xxhash64(_hash(x)))
        return F.when((i == 0) | (here != F.shiftright(F.get(F.col(b), i - 1), BIN)), F.shiftleft(here, VALUE).bitwiseOR(F.shiftrightunsigned(h, 64 - VALUE)) - F.lit(1 << 31))

    return d.withColumn(m, F.transform(F.col(b), value)).withColumn(out, F.filter(m, lambda x: x.isNotNull()).cast("array<int>")).drop(b, m)


def likeness(x: str, y: str) -> Column:
    """Share of equal bins among those that either of two fingerprints fills; 1 for two empty ones."""
    def filled(c: str) -> Column:
        return F.transform(F.col(c), lambda v: F.shiftright(v, VALUE))

    either = F.size(F.array_union(filled(x), filled(y)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / either).cast("double")


def shown(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda v: F.lpad(F.lower(F.hex(v.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def numbered(ids: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """ids with rank, from 0 by ascending `order`, and their number: a range shuffle and the partitions' prefix sums."""
    spark = ids.sparkSession
    placed = ids.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_before")
    ranked = placed.withColumn("_part", part).join(counts, "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return ranked.drop("_part", "_before", "_at"), placed.count()


def order_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many of the next document's, by
    descending id; a null id is the last, and rows with one id follow each other by their texts' hashes, in any order
    where these are equal, too. A null or empty text is empty, with an empty fingerprint. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = prepared(docs.sparkSession)
    none = F.lit(-(1 << 63))
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ids = None
    ranked, total = numbered(d.groupBy("_key").agg(F.max(F.char_length("_text")).alias("_chars")), "_key")
    if total != d.select("_key").count():
        # ids repeat: rows get keys of their own, in the ids' order, and are written once
        own = d.withColumnRenamed("_key", "_id").repartitionByRange(parts(spark), "_id", F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text")).withColumn("_key", F.monotonically_increasing_id()).checkpoint()
        ids, d = own.select("_key", "_id"), own.select("_key", "_text")
        ranked, total = numbered(d.select("_key", F.char_length("_text").alias("_chars")), "_key")
    after = ranked.select(F.col("_key").alias("_next"), ((F.col("rank") + 1) % max(total, 1)).alias("rank"))
    link = ranked.join(after, "rank").select("_key", "_next", "_chars").checkpoint()
    taken = link.select(F.col("_key").alias("_of"), F.col("_next").alias("_key"), F.floor(F.col("_chars") / 3).cast("int").alias("_need"))
    pieces = d.join(taken, "_key").select(F.col("_of").alias("_key"), F.substring("_text", F.lit(1), F.col("_need")).alias("_piece"), F.col("_key").alias("_next"))
    rows = d.join(pieces, "_key").withColumn("n_chars", F.char_length("_text").cast("long"))
    edited = F.concat(F.substring("_text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")), F.col("_piece"))
    rows = rows.withColumn("_edited", edited).drop("_piece")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    rows = with_fingerprint(with_fingerprint(rows, "_text", "_own", k).drop("_text"), "_edited", "_new", k).drop("_edited")
    done = rows.select("_key", "_next", "n_chars", "edited_sha256", "_own", "_new").checkpoint()
    other = done.select(F.col("_key").alias("_next"), F.col("_own").alias("_other"))
    joined = done.join(other, "_next")
    joined = joined.join(ids, "_key") if ids else joined.withColumn("_id", F.col("_key"))
    return joined.select(
        F.when(F.col("_id") != none, F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256", shown("_own").alias("fingerprint"), shown("_new").alias("edited_fingerprint"),
        likeness("_own", "_new").alias("near_edited"), likeness("_own", "_other").alias("near_next"),
    )


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_fingerprints(table(prepared(spark), sf_dir, "documents"))
