"""Line dedup: every repeated line stays only in the first document that holds it.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of at least
``min_chars`` code points found in two or more documents lose all their lines except in the
smallest ``doc_id`` holding them.

Plan, with DataFrame functions only:

1. Each line becomes a 40-byte row (document, position, 128-bit key hash), written once to the
   shared folder; the texts aren't read again before the end.
2. Hashes are range-partitioned, with a secondary sort by document and position, and a running
   window streams the first owner of each hash.
3. Frequent hashes never meet in one task: a frequent-items sketch of bounded size names them,
   their owners are a partially aggregated minimum of at most that many rows, and each of their
   lines is decided where it lies by a broadcast of those rows.
4. Dropped positions become a compressed bitmap per document: pairs (word, mask) for the 64-line
   words that lose a line; in every other word all lines stay.

Defined cases: NULL or empty text is one empty line. A NULL ``doc_id`` neither owns nor loses
lines. Rows that share a ``doc_id`` are one document for ownership, and each keeps its own bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwarden.llm.common import LOWER, SPACES, UPPER, documents, stage

MIN_CHARS = 10
#: Most hashes that the sketch may name; a hash with a larger share of the lines is among them.
FREQUENT = 256


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def text_hash(text: Column) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of every line that counts."""
    lines = docs.where("doc_id is not null").select(
        "doc_id", text_hash(F.col("text")).alias("version"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )


def dropped_lines(hashes: DataFrame) -> DataFrame:
    """(doc_id, version, pos) of the lines to drop."""
    spark = hashes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = hashes.freqItems(["h1"], 1 / FREQUENT).first()[0] or []
    is_frequent = F.col("h1").isin(frequent) if frequent else F.lit(False)
    ranged = hashes.where(~is_frequent).repartitionByRange(parts, "h1", "h2")
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    rare = ranged.withColumn("owner", F.first("doc_id").over(order))
    hot = hashes.where(is_frequent)
    hot_owner = hot.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
    hot = hot.join(F.broadcast(hot_owner), ["h1", "h2"])
    columns = ["doc_id", "version", "pos", "owner"]
    return rare.select(*columns).unionByName(hot.select(*columns)).where("doc_id != owner").drop("owner")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, n_dropped, keep) of the documents that lose a line.

    ``keep`` is array<struct<word: int, mask: bigint>>, ascending: bit b of mask is set if line
    64 * word + b stays. Words not listed keep all their lines.
    """
    dropped = dropped_lines(stage(hashed_lines(docs, min_chars), "line-hashes"))
    words = (
        dropped.repartition("doc_id", "version")
        .groupBy("doc_id", "version", F.expr("cast(pos div 64 as int)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    )
    return words.groupBy("doc_id", "version").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("mask")))).alias("keep"),
    )


def _dense(keep: Column) -> Column:
    """Masks by word number, gaps filled with all ones."""

    def padded(entry: Column, at: Column) -> Column:
        before = F.when(at == 0, F.lit(-1)).otherwise(F.get(keep, at - 1)["word"])
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), entry["word"] - before - 1), F.array(entry["mask"]))

    return F.flatten(F.transform(keep, padded))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row: struct of all columns of docs, n_lines, n_dropped, kept: the text that stays)."""
    rows = docs.select(F.struct("*").alias("row"))
    marks = bitmaps.select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "n_dropped", _dense(F.col("keep")).alias("masks")
    )
    text = F.col("row.text")
    joined = rows.join(
        marks, (F.col("row.doc_id") == F.col("_id")) & (text_hash(text) == F.col("_version")), "left"
    )

    def stays(line: Column, at: Column) -> Column:
        mask = F.coalesce(F.get(F.col("masks"), F.floor(at / 64).cast("int")), F.lit(-1).cast("long"))
        return F.expr("1L").bitwiseAND(F.call_function("shiftright", mask, (at % 64).cast("int"))) == 1

    kept = F.when(F.col("masks").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.filter(lines_of(text), stays), "\n")
    )
    return joined.select(
        "row",
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines removed; no document is dropped."""
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    lengths = "n_chars" in docs.columns
    fields = [
        F.col("kept").alias(c) if c == "text" else F.char_length("kept").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" and lengths else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return out.select(*fields)


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACE_SQL}), '{UPPER}', '{LOWER}') AS key FROM lines
), owned AS (
  SELECT *, CASE WHEN length(key) >= {MIN_CHARS} THEN min(doc_id) OVER (PARTITION BY key) ELSE doc_id END AS owner FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> owner) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE doc_id = owner), '')) AS kept_sha256
FROM owned GROUP BY doc_id
"""

QUERIES = {"op1_line_dedup": (op1_line_dedup, SQL)}
