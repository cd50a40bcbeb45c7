"""Near duplicates among embeddings: cross-polytope hashing, multiprobe buckets, verified pairs.

* Hash: a vector is rotated by three rounds of random signs and fast Hadamard transforms; the axis it lies
  nearest to, with its sign, is the symbol of one hash. ``k`` hashes name a bucket of one of ``L`` tables.
* Multiprobe: a vector enters the buckets of its ``PROBES`` nearest axes for each hash, so vectors meet in
  a table if every hash shares one of them. ``k`` grows with the number of vectors, so buckets stay small, and
  ``L`` is the least number of tables under which a pair at the threshold is missed by all with a chance of
  ``MISS`` at most; the chance of one hash is measured by a fixed simulation of pairs at the threshold.
* Copies first: equal directions are one class with a weight, merged before rows are exchanged.
* Cliques: within a bucket each class is compared with the bucket's first class; one within half the
  threshold's angle of it joins that centre's clique. All members of a clique are linked to each other by the triangle
  inequality, so a group of n near copies costs n comparisons and no pair rows. Buckets are salted as the
  table grows, and every salt has a first class of its own.
* Pairs: cliques that share a bucket are compared by their centres. Buckets with more than ``BLOCK``
  cliques are dealt into blocks, and each pair of blocks is one piece of work; only pairs whose angle is within reach leave it.
* Verification: radii settle pairs of cliques that are linked as a whole or not at all. Else each member of one
  is compared with the other's centre, and what is still open pair by pair in double precision.

No bucket is cut and no candidate dropped. Cliques and their pairs only stand for links that hold: links
found have a cosine of the threshold or more, as computed from the vectors or by a margin of ``SLACK`` radians.

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows with a NULL id,
link with nothing and are their own component. Vectors of unlike length are never compared. Equal rows are
vectors of their own, linked to each other. Rows that share an id are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import U64, map_arrow, mix, stage
from callwarden.llm.components import components

COSINE = 0.95
PROBES = 2
#: Chance that all tables miss a pair at the threshold.
MISS = 1e-4
#: Vectors of a bucket that ``k`` aims at.
OCCUPANCY = 32
#: Cliques of a bucket compared in one piece.
BLOCK = 1024
#: Rows of first probes for each salt.
SALT_ROWS = 1 << 24
SLACK = 1e-6
SEED = 77
#: Rows handled at once in a task.
STEP = 4096


# ---------------------------------------------------------------- hashing


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (a power of two long) after a round of signs and a Hadamard transform for each row of ``signs``."""
    size = x.shape[1]
    for row in signs:
        x = x * row
        half = 1
        while half < size:
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
            half *= 2
    return x


def padded(dim: int) -> int:
    return 1 << max(dim - 1, 0).bit_length()


def nearest_axes(x: np.ndarray, dim: int, number: int, probes: int) -> np.ndarray:
    """Symbols (twice the axis, one more if positive) of the nearest axes after rotation ``number``, nearest first."""
    size = padded(dim)
    signs = np.random.default_rng([SEED, dim, number]).choice([-1.0, 1.0], (3, size))
    turned = rotate(np.pad(x, ((0, 0), (0, size - x.shape[1]))), signs)
    axes = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, : min(probes, size)]
    return axes * 2 + (np.take_along_axis(turned, axes, axis=1) > 0)


@cache
def meeting_chance(dim: int, cosine: float, probes: int) -> float:
    """Share of pairs at the threshold that have one of their nearest axes in common."""
    if dim == 1:
        return 1.0
    draw = np.random.default_rng([SEED, dim])
    x, z = draw.standard_normal((2, 4096, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    y = cosine * x + np.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = (nearest_axes(v, dim, 0, probes) for v in (x, y))
    # two standard errors less, so that the number of tables errs upwards
    share = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()
    return float(max(share - 2 * np.sqrt(share * (1 - share) / 4096), 0.05))


@cache
def design(count: int, dim: int, cosine: float, probes: int) -> tuple[int, int]:
    """(hashes of a table, tables) for ``count`` vectors."""
    fan = 2 * padded(dim) / min(probes, padded(dim))
    k = max(int(np.ceil(np.log(max(count / OCCUPANCY, 1)) / np.log(fan))), 1)
    chance = meeting_chance(dim, cosine, probes) ** k
    return k, max(int(np.ceil(np.log(MISS) / np.log1p(-min(chance, 0.999999)))), 1)


def buckets(x: np.ndarray, count: int, cosine: float, probes: int) -> Iterator[np.ndarray]:
    """For each table, the bucket names of the rows of ``x``; the first column is the nearest axes'."""
    dim = x.shape[1]
    k, tables = design(count, dim, cosine, PROBES)
    for table in range(tables):
        names = np.full((len(x), 1), mix(np.array([table * 1_000_003 + dim], np.uint64))[0])
        for number in range(k):
            symbols = nearest_axes(x, dim, table * k + number, probes).astype(np.uint64)
            names = mix(names[:, :, None] * U64(0x9E3779B97F4A7C15) + symbols[:, None, :]).reshape(len(x), -1)
        yield names


# ---------------------------------------------------------------- Arrow stages


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``c``, a 128-bit name of the direction, and ``u``, the unit vector's doubles; NULL if it has none."""
    from hashlib import blake2b

    for batch in batches:
        lists = batch.column("embedding")
        units: list[bytes | None] = []
        values = pc.list_flatten(lists)
        flat = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            x = flat[a:b]
            most = np.abs(x).max(initial=0.0)
            if not np.isfinite(most) or most == 0:
                units.append(None)
                continue
            x = x / most + 0.0
            units.append((x / np.sqrt(x @ x)).tobytes())
        names = [None if u is None else blake2b(u, digest_size=16).digest() for u in units]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "c", "u"])


def matrices(units: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector."""
    raw = units.to_pylist()
    size = np.array([len(u) for u in raw], np.int64)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, np.frombuffer(b"".join(raw[i] for i in rows)).reshape(len(rows), -1)


def _first_probes(count: int, cosine: float, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for rows, x in matrices(part.column("u")):
                    some = part.take(pa.array(rows))
                    salt = pa.array((mix(x.sum(axis=1).view(np.uint64)) % U64(salts)).astype(np.int32))
                    for names in buckets(x, count, cosine, 1):
                        yield pa.RecordBatch.from_arrays([pa.array(names[:, 0].view(np.int64)), salt, some.column("c"), some.column("u")], names=["key", "salt", "c", "u"])

    return run


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _to_first(cosine: float):
    """Rows sorted by (key, salt, c): those within half the threshold's angle of their bucket's first class."""
    half = np.arccos(cosine) / 2 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (key, salt, c, u) of the first row of the bucket under way
        for batch in batches:
            keys, salts = (batch.column(i).to_numpy() for i in (0, 1))
            names, units = batch.column("c").to_pylist(), batch.column("u").to_pylist()
            begin = np.concatenate([[held is None or (keys[0], salts[0]) != held[:2]], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])])
            first = np.maximum.accumulate(np.where(begin, np.arange(len(keys)), -1))
            heads = [(names[i], units[i]) if i >= 0 else held[2:] for i in first]
            for a in range(0, len(keys), STEP):
                rows = np.flatnonzero(~begin[a : a + STEP]) + a
                rows = np.array([i for i in rows if len(units[i]) == len(heads[i][1])], np.int64)
                for length in {len(units[i]) for i in rows}:
                    some = [i for i in rows if len(units[i]) == length]
                    x = np.frombuffer(b"".join(units[i] for i in some)).reshape(len(some), -1)
                    y = np.frombuffer(b"".join(heads[i][1] for i in some)).reshape(len(some), -1)
                    away = angles(np.einsum("ij,ij->i", x, y))
                    near = np.flatnonzero(away <= half)
                    if len(near):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[some[i]] for i in near], pa.binary()), pa.array([heads[some[i]][0] for i in near], pa.binary()), pa.array(away[near])], names=["c", "clique", "radius"]
                        )
            held = (keys[-1], salts[-1], *heads[-1])

    return run


def _probes(count: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for rows, x in matrices(part.column("u")):
                    cliques = np.array(part.column("clique").take(pa.array(rows)).to_pylist(), dtype=object)
                    for names in buckets(x, count, cosine, PROBES):
                        both = set(zip(np.repeat(cliques, names.shape[1]).tolist(), names.ravel().view(np.int64).tolist(), strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array([b for _, b in both], pa.int64()), pa.array([a for a, _ in both], pa.binary())], names=["key", "clique"])

    return run


def _close_cliques(cosine: float):
    """Rows sorted by (key, low, high), a piece of a bucket each: pairs of cliques whose centres are within reach."""
    reach = np.arccos(cosine) + SLACK

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        piece, block, radius = (table.column(c).to_numpy() for c in ("piece", "block", "radius"))
        names, raw = table.column("clique").to_pylist(), table.column("u").to_pylist()
        width = max(map(len, raw))  # vectors of unlike length never share a bucket, so filling them up is harmless
        x = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in raw)).reshape(len(raw), -1)
        edges = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1], [True]]))
        size = np.diff(edges)
        left, right, cosines = [], [], []
        single = table.column("single").to_numpy(zero_copy_only=False)

        def keep(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
            ok = (angles(c) <= reach + radius[i] + radius[j]) & (single[i] | (block[i] != block[j]))
            left.append(i[ok])
            right.append(j[ok])
            cosines.append(c[ok])

        small = np.repeat(size <= 48, size)
        for shift in range(1, int(size[size <= 48].max(initial=1))):
            i = np.flatnonzero(small[:-shift] & (piece[shift:] == piece[:-shift]))
            for at in range(0, len(i), 1 << 15):
                some = i[at : at + (1 << 15)]
                keep(some, some + shift, np.einsum("ij,ij->i", x[some], x[some + shift]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 48:
                for row in range(a, b, 256):
                    c = x[row : min(row + 256, b)] @ x[a:b].T
                    i, j = np.nonzero(angles(c) <= reach + radius[row : min(row + 256, b), None] + radius[None, a:b])
                    upper = a + j > row + i
                    keep(row + i[upper], a + j[upper], c[i[upper], j[upper]])
        i, j = np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])
        if len(i):
            ends = [(names[p], names[q]) for p, q in zip(i, j, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([min(e) for e in ends], pa.binary()), pa.array([max(e) for e in ends], pa.binary()), pa.array(np.concatenate(cosines))], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows < STEP:
                held = table
                continue
            marks = [table.column(c).to_numpy() for c in ("key", "low", "high")]
            new = np.concatenate([[True], np.any([m[1:] != m[:-1] for m in marks], axis=0)])
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from pairs(table.slice(0, last).append_column("piece", pa.array(np.cumsum(new)[:last])))
            held = table.slice(last)
        if held is not None:
            marks = [held.column(c).to_numpy() for c in ("key", "low", "high")]
            new = np.concatenate([[True], np.any([m[1:] != m[:-1] for m in marks], axis=0)])
            yield from pairs(held.append_column("piece", pa.array(np.cumsum(new))))

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``ux`` and ``uy`` replaced by their cosine."""
    for batch in batches:
        rest = [c for c in batch.schema.names if c not in ("ux", "uy")]
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist())) for c in ("ux", "uy"))
        size = np.array([len(u) // 8 for u in batch.column("ux").to_pylist()], np.int64)
        sums = np.add.reduceat(x * y, np.concatenate([[0], np.cumsum(size)[:-1]])) if len(size) else np.empty(0)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(sums)], names=[*rest, "cosine"])


# ---------------------------------------------------------------- Spark side


def cliques(classes: DataFrame, count: int, tables: int, cosine: float) -> DataFrame:
    """(c, clique, radius): the clique of each class, named by its centre, and the angle to the centre."""
    salts = max(count * tables // SALT_ROWS, 1)
    rows = map_arrow(classes.select("c", "u"), _first_probes(count, cosine, salts), "key long, salt int, c binary, u binary")
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "c")
    near = map_arrow(dealt, _to_first(cosine), "c binary, clique binary, radius double")
    best = near.groupBy("c").agg(F.min(F.struct("clique", "radius")).alias("best")).select("c", "best.*")
    joined = classes.join(best, "c", "left")
    return joined.select(*classes.columns, F.coalesce("clique", "c").alias("clique"), F.coalesce("radius", F.lit(0.0)).alias("radius"))


def clique_pairs(members: DataFrame, groups: DataFrame, count: int, cosine: float) -> DataFrame:
    """(a, b, cosine) of cliques that share a bucket and whose centres are near enough for a link."""
    keys = map_arrow(members.select("clique", "u"), _probes(count, cosine), "key long, clique binary").distinct()
    keys = stage(keys, "near-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").cast("int"))
    met = keys.join(shared.select("key", "blocks"), "key")
    block = F.pmod(F.xxhash64("clique"), F.col("blocks")).cast("int")
    met = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    pieces = met.select("key", low, high, "block", (F.col("block") == F.col("other")).alias("single"), "clique")
    rows = pieces.join(groups.select("clique", "u", "radius"), "clique").select("key", "low", "high", "block", "single", "clique", "u", "radius")
    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "clique")
    found = map_arrow(dealt, _close_cliques(cosine), "a binary, b binary, cosine double")
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage(map_arrow(columns, _units, "vec_id long, c binary, u binary"), "near-rows")
    valid = rows.where("vec_id is not null and c is not null")
    classes = valid.groupBy("c").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("u").alias("u"))
    classes = stage(classes, "near-classes")
    count, longest = classes.agg(F.count("*"), F.max(F.length("u"))).first()
    tables = design(count, longest // 8, cosine, PROBES)[1] if count else 1
    members = stage(cliques(classes, count, tables, cosine), "near-members")
    groups = members.groupBy("clique").agg(F.sum("n").alias("weight"), F.max("radius").alias("radius"), F.count("*").alias("classes"))
    groups = stage(groups.join(classes.select(F.col("c").alias("clique"), "u"), "clique"), "near-groups")
    pairs = clique_pairs(members, groups, count, cosine)
    facts = groups.select("clique", "weight", "radius", "classes")
    for end in "ab":
        pairs = pairs.join(facts.select(*[F.col(c).alias(c + "_" + end if c != "clique" else end) for c in facts.columns]), end)
    limit = float(np.arccos(cosine))
    angle = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))
    single = (F.col("radius_a") == 0) & (F.col("radius_b") == 0)
    whole = F.when(single, F.col("cosine") >= cosine).otherwise(angle + F.col("radius_a") + F.col("radius_b") <= limit - SLACK)
    pairs = stage(pairs.select("*", single.alias("single"), whole.alias("whole")), "near-pairs")
    sure = pairs.where("whole")
    open_pairs = pairs.where("not whole and not single").select("a", "b", "weight_b", "radius_b")
    # members of a against the centre of b
    mine = members.select(F.col("clique").alias("a"), F.col("c").alias("x"), F.col("n").alias("nx"), F.col("u").alias("ux"))
    centre = groups.select(F.col("clique").alias("b"), F.col("u").alias("uy"))
    tried = open_pairs.join(mine, "a").join(centre, "b").select("a", "b", "weight_b", "radius_b", "x", "nx", "ux", "uy")
    tried = map_arrow(tried, _cosines, "a binary, b binary, weight_b long, radius_b double, x binary, nx long, cosine double")
    at_centre = F.when(F.col("radius_b") == 0, F.col("cosine") >= cosine).otherwise(angle + F.col("radius_b") <= limit - SLACK)
    tried = stage(tried.where((angle - F.col("radius_b") <= limit + SLACK)).withColumn("whole", at_centre), "near-tried")
    to_clique = tried.where("whole")
    theirs = members.select(F.col("clique").alias("b"), F.col("c").alias("y"), F.col("n").alias("ny"), F.col("u").alias("uy"))
    last = tried.where("not whole and radius_b > 0").select("a", "b", "x", "nx").join(theirs, "b")
    last = last.join(classes.select(F.col("c").alias("x"), F.col("u").alias("ux")), "x").select("a", "b", "x", "nx", "y", "ny", "ux", "uy")
    last = stage(map_arrow(last, _cosines, "a binary, b binary, x binary, nx long, y binary, ny long, cosine double").where(F.col("cosine") >= cosine), "near-last")
    by_clique = (
        sure.select(F.col("a").alias("clique"), F.col("weight_b").alias("more"))
        .union(sure.select("b", "weight_a"))
        .union(to_clique.select("b", "nx"))
        .groupBy("clique").agg(F.sum("more").alias("more"))
    )
    by_class = (
        to_clique.select(F.col("x").alias("c"), F.col("weight_b").alias("own"))
        .union(last.select("x", "ny"))
        .union(last.select("y", "nx"))
        .groupBy("c").agg(F.sum("own").alias("own"))
    )
    links = sure.select("a", "b").union(to_clique.select("a", "b")).union(last.select("a", "b"))
    roots = stage(components(links), "near-roots")
    placed = groups.select("clique", "weight").join(roots.withColumnRenamed("node", "clique"), "clique", "left").join(by_clique, "clique", "left")
    placed = placed.select("clique", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("shared"), F.coalesce("root", "clique").alias("root"))
    full = members.select("c", "clique", "least").join(placed, "clique").join(by_class, "c", "left")
    full = stage(full.select("c", "least", "root", (F.col("shared") + F.coalesce("own", F.lit(0))).alias("n_links")), "near-full")
    smallest = full.groupBy("root").agg(F.min("least").alias("component_id"))
    by_c = full.join(smallest, "root").select("c", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("c")).alias("c")).join(by_c, "c", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), found AS (
  SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reached WHERE a = vec_id), vec_id)) AS component_id
  FROM embeddings
)
SELECT *, vec_id = component_id AS kept FROM found"""

QUERIES = {"op13_embedding_near": (op13_embedding_near, SQL)}
