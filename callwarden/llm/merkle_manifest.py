"""Merkle manifest of a dataset: leaves, one tree for each language, a root, and proofs.

H is SHA-256 of its concatenated inputs as lowercase hex; digests enter as hex text. A leaf is H of
doc_id, source, lang, n_chars and text, each ``-`` if NULL, else UTF-8 byte count, ``:`` and value.

* Places: leaves are ranged and sorted by (language, doc_id, leaf) and numbered inside their part; sums of
  rows for each (part, language) turn that into a place in the language's tree. Only digests are
  exchanged, never texts.
* Levels: a node's siblings have computed indices (``index XOR 1`` in binary trees, the other slots of
  the run at shifted offsets otherwise), so each level is one equijoin for each sibling; the keys are unique, so
  no key is hot. Rows of slot zero emit the parents. Every level is written to the shared folder, so
  lineage stays short and n leaves cost about 2 n joined rows.
* The trees' last nodes, in order of language, are the leaves of one more tree, built by the same functions.
* Proofs come down again: a node's proof is its run's other digests followed by the proof of its parent,
  so one join a level hands the shared part of the proofs to the children, as raw bytes.

Tampering a leaf and folding it with its siblings is one ``aggregate`` over the proof in the row.

Defined cases: NULL languages are a tree of their own, the first; NULL ids come first in their tree; rows
that share an id are ordered by leaf, and equal rows are leaves of their own. A tree of one leaf
has that leaf as subroot; the last run of a level may be shorter, and even a single node of it is hashed
again. An empty proof is H of nothing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwarden.llm.common import doc_crc, documents, stage

FANOUT = 2
#: Documents whose crc32 this divides are tampered with.
TAMPER = 7
#: Rows of the table of parts and trees up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 1 << 17


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(F.coalesce(digest, F.lit(b""))))


def _h(*digests: Column) -> Column:
    """H of digests, as bytes."""
    return F.unhex(F.sha2(F.concat(*[_hex(d) for d in digests]), 256))


def _field(name: str, value: Column | None = None) -> Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """Leaf of a row of ``documents`` (bytes), with another ``n_chars`` on demand."""
    fields = [_field("doc_id"), _field("source"), _field("lang"), _field("n_chars", n_chars), _field("text")]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def tree_of(lang: Column) -> Column:
    """Key of a language's tree; sorts NULL first and the others by their bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``idx``, the place of a row within its ``tree`` by ``order``, and ``size``, its rows.

    Rows are numbered inside their ranges; sums for each range and tree, a table as long as
    there are parts and trees, give the offsets.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    pieces = ranged.groupBy("tree", part).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("low")
    pieces = stage(pieces.select("tree", "part", before.alias("shift"), F.sum("n").over(whole).alias("size")), f"{name}-parts")
    if pieces.count() <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    return ranged.withColumn("part", part).join(pieces, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Add ``before`` and ``after``: digests of a node's run on its left and on its right, as bytes."""
    slot = F.col("idx") % fanout
    out = nodes
    for shift in range(1, fanout):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + (slot + shift) % fanout
        other = nodes.select("tree", F.col("idx").alias("other"), F.col("digest").alias(f"d{shift}"))
        out = out.withColumn("other", at).join(other, ["tree", "other"], "left").drop("other")
    none = F.lit(b"")

    def side(places: range) -> Column:
        digests = []
        for place in places:
            known = none
            for mine in range(fanout):
                if mine != place:
                    known = F.when(slot == mine, F.coalesce(F.col(f"d{(place - mine) % fanout}"), none)).otherwise(known)
            left = F.lit(place) < slot
            digests.append((left, known))
        return digests

    pieces = side(range(fanout))
    before = F.concat(*[F.when(left, d).otherwise(none) for left, d in pieces])
    after = F.concat(*[F.when(left, none).otherwise(d) for left, d in pieces])
    return out.select(*nodes.columns, before.alias("before"), after.alias("after"))


def build(leaves: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees of ``leaves`` (tree, idx, size, digest, ...), and (tree, depth, digest) of their last nodes.

    Level 0 keeps all columns of the leaves. Only the largest size, a number, reaches the driver.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 0
    level, levels, roots = leaves, [], []
    while True:
        depth = F.lit(len(levels)).alias("depth")
        roots.append(level.where("size = 1").select("tree", depth, "digest"))
        if largest <= 1:
            break
        level = stage(with_siblings(level.where("size > 1"), fanout), f"{name}-{len(levels)}")
        levels.append(level)
        heads = level.where(F.col("idx") % fanout == 0)
        level = heads.select(
            "tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"),
            _h(F.col("before"), F.col("digest"), F.col("after")).alias("digest"),
        )
        largest = -(-largest // fanout)
    ends = roots[0]
    for more in roots[1:]:
        ends = ends.union(more)
    return levels, ends


def proofs(levels: list[DataFrame], ends: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, proof, root) of the leaves, from (tree, depth, proof, root) of the trees' last nodes.

    ``proof`` has a (before, after) pair of bytes for each level, the leaf's own run first.
    """

    def last(depth: int) -> DataFrame:
        return ends.where(F.col("depth") == depth).select("tree", F.lit(0).cast("long").alias("idx"), "proof", "root")

    above = last(len(levels))
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].select("tree", F.expr(f"idx div {fanout}").alias("up"), "idx", "before", "after")
        joined = nodes.join(above.withColumnRenamed("idx", "up"), ["tree", "up"])
        proof = F.concat(F.array(F.struct("before", "after")), F.col("proof"))
        above = joined.select("tree", "idx", proof.alias("proof"), "root").union(last(depth))
    return above


def manifest(docs: DataFrame, fanout: int = FANOUT, tamper: int = TAMPER) -> DataFrame:
    """One row for each document: leaf, subroot, root, proof and the root folded from its (tampered) leaf."""
    docs = docs.select(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    changed = F.coalesce(doc_crc() % tamper == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = docs.select(
        tree_of(F.col("lang")).alias("tree"), "doc_id", leaf_digest().alias("digest"),
        F.when(changed, leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"),
    )
    leaves = stage(placed(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "merkle-rows"), "merkle-leaves")
    levels, ends = build(leaves.select("tree", "idx", "size", "digest"), fanout, "merkle")
    ends = stage(ends, "merkle-subroots")
    top = placed(ends.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), [F.col("of")], "merkle-tops")
    top = stage(top, "merkle-top")
    top_levels, top_end = build(top.select("tree", "idx", "size", "digest"), fanout, "merkle-top")
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    down = proofs(top_levels, top_end.select("tree", "depth", none.alias("proof"), F.col("digest").alias("root")), fanout)
    tops = down.join(top.select("idx", "of", F.col("digest").alias("subroot")), "idx")
    starts = ends.join(tops.select(F.col("of").alias("tree"), "proof", "root", "subroot"), "tree")
    starts = stage(starts.select("tree", "depth", "proof", F.struct("root", "subroot").alias("root")), "merkle-starts")
    found = leaves.join(proofs(levels, starts, fanout), ["tree", "idx"])
    folded = F.aggregate("proof", F.coalesce("tampered", "digest"), lambda h, s: _h(s["before"], h, s["after"]))
    path = F.array_join(F.transform("proof", lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")
    out = found.select(
        "doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("root.subroot")).alias("subroot"), _hex(F.col("root.root")).alias("root"),
        F.sha2(path, 256).alias("proof_sha256"), _hex(folded).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


def _sql_field(name: str) -> str:
    return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"


#: crc32 of a text in DuckDB: one table step for each byte of its (ASCII) digits.
def sql_crc32(text: str) -> str:
    step = "list_reduce(list_prepend(v, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    one = step.replace("(v,", "(xor(c, b),")
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {one}), 4294967295)"


def _sql(fanout: int = 2, tamper: int = TAMPER) -> str:
    """The same by recursion over levels; each level carries the leaves' proofs and both folds along."""
    leaf = "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    wrong = leaf.replace("n_chars", "(n_chars + 1)")

    def level(tree: str) -> str:
        # members of a run: the distinct nodes of the level with the same parent
        return f"""
  SELECT {tree}, doc, cast((n + 1) // 2 AS BIGINT), place // 2, sha256(concat(l, r)) AS node,
    proof || CASE WHEN place % 2 = 1 THEN l ELSE coalesce(r, '') END,
    sha256(CASE WHEN place % 2 = 1 THEN concat(l, fold) ELSE concat(fold, r) END)
  FROM (SELECT *, max(node) FILTER (place % 2 = 0) OVER run AS l, max(node) FILTER (place % 2 = 1) OVER run AS r FROM PREV WHERE n > 1
    WINDOW run AS (PARTITION BY {tree}, place // 2))"""

    return f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS doc, doc_id, coalesce('=' || lang, '') AS tree, {leaf} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {sql_crc32("CAST(doc_id AS VARCHAR)")} % {tamper} = 0 THEN {wrong} ELSE {leaf} END AS tampered FROM documents
), leaves AS (
  SELECT tree, doc, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf, tampered FROM base
), up(tree, doc, n, place, node, proof, fold) AS (
  SELECT tree, doc, n, place, leaf, '', tampered FROM leaves UNION ALL {level("tree").replace("PREV", "up")}
), tops AS (
  SELECT tree, doc, node AS subroot, proof, fold FROM up WHERE n = 1
), names AS (
  SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT tree FROM tops)
), over(one, doc, n, place, node, proof, fold) AS (
  SELECT 1, doc, n, place, subroot, proof, fold FROM tops JOIN names USING (tree) UNION ALL {level("one").replace("PREV", "over")}
)
SELECT doc_id, leaf, subroot, node AS root, sha256(over.proof) AS proof_sha256, over.fold AS folded_root, over.fold = node AS verified
FROM over JOIN base USING (doc) JOIN tops USING (doc) WHERE over.n = 1"""


QUERIES = {"op12_merkle_manifest": (op12_merkle_manifest, _sql())}
