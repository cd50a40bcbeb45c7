"""Structure repair, Merkle manifest and embedding near-dedup against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from callwarden.llm import embedding_near, merkle_manifest, structure_repair

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---------------------------------------------------------------- structure repair


def least_suffixes(codes):
    """(cost, audit) by dynamic programming over suffixes."""
    none = (10**9, "")
    after = {q: (0, "") if q in (structure_repair.EMPTY, structure_repair.A) else none for q in range(4)}
    for i in range(len(codes), -1, -1):
        now = dict(after) if i == len(codes) else dict.fromkeys(range(4), none)
        for _ in range(4):
            for q in range(4):
                for initial, j, p, c in structure_repair._leaving(codes, i, q):
                    rest = now[p] if j == i else after[p]
                    if rest[0] < none[0]:
                        now[q] = min(now[q], (c + rest[0], initial + rest[1]))
        after = now
    return after[structure_repair.EMPTY]


def test_bidirectional_search_matches_suffix_tables():
    draw = random.Random(4)
    for _ in range(3000):
        codes = bytes(draw.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(draw.randrange(13)))
        assert structure_repair.cheapest_edits(codes) == least_suffixes(codes), codes


def test_long_conversations_stay_linear():
    draw = random.Random(5)
    codes = bytes(draw.choice([1, 2, 5, 6, 8, 3]) for _ in range(20000))
    cost, audit = structure_repair.cheapest_edits(codes)
    assert cost == least_suffixes(codes[:0])[0] or sum(audit.count(c) for c in "KRD") == len(codes)


def odd_conversations():
    draw = random.Random(6)
    rows = [
        (None, 1, "user", "Hi."), (None, None, None, None), (1, None, "user", "Hello there."), (1, None, "user", "Hello there."), (1, 2, "assistant", "Yes."),
        (1, 2, "assistant", "Yes."), (2, 1, "", "x."), (2, 2, "tool", "y"), (3, 1, "system", "z."), (4, 5, "user", "long " * 20000 + "."), (4, 9, "assistant", "Ü!"),
    ]
    rows += [(9, i, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["A.", "B!", "cc", " ", "D?"])) for i in range(500)]
    return rows + [(i, j, draw.choice(["user", "assistant"]), f"t{j % 3}.") for i in range(10, 150) for j in range(3)]


def sql_rows(con, sql):
    found = con.execute(sql)
    return [d[0] for d in found.description], sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("pieces", [1, 64])
def test_structure_repair_matches_sql(spark, pieces):
    frame = spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string")
    clash = frame.selectExpr("*", "'x' as kind", "1 as at", "2 as copies", "3 as code").repartition(pieces)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in structure_repair.repair_conversations(clash).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    _, want = sql_rows(con, structure_repair.SQL)
    assert got == want


def test_structure_repair_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure_repair.repair_conversations(frame).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = structure_repair.repair_conversations(spark.createDataFrame([(dropped, 0, "user", "x")], frame.schema)).collect()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256) == (dropped, 0, 0, "", h())


# ---------------------------------------------------------------- Merkle manifest


def run_proofs(nodes, fanout):
    """(root, proof of every leaf) by plain lists."""
    proofs, owned = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        tops, theirs = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for j in range(len(run)):
                for leaf in owned[i + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            tops.append(h(*run))
            theirs.append(sum(owned[i : i + fanout], []))
        nodes, owned = tops, theirs
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(*map(field, (r[0], r[2], r[1], r[3] if r[3] is None else r[3] + more, r[4])))
    trees = {}
    for row in rows:
        trees.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    for members in trees.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = [run_proofs([leaf(r) for r in trees[k]], fanout) for k in sorted(trees)]
    root, tops = run_proofs([b[0] for b in built], fanout)
    out = []
    for key, (subroot, own), top in zip(sorted(trees), built, tops):
        for row, proof in zip(trees[key], own):
            proof = proof + top
            folded = leaf(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for a, b in proof:
                folded = h(a, folded, b)
            out.append((row[0], leaf(row), subroot, root, h(*[a + b for a, b in proof]), folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows():
    texts = [(d, t) for d, t in ODD]
    rows = [(d, ["en", None, "é", "e"][n % 4], "s" if n % 3 else None, None if n % 5 == 0 else n, t) for n, (d, t) in enumerate(texts)]
    return rows + [(i, "en", "web", i, f"text {i}") for i in range(20, 61)] + [(70, "zz", None, 1, "alone"), (21, "en", "web", 21, "text 21")]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_matches_plain_trees(spark, fanout):
    rows = manifest_rows()
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string").selectExpr("*", "1 as tree", "2 as idx", "3 as digest", "4 as leaf")
    got = sorted((tuple(r) for r in merkle_manifest.manifest(frame, fanout).collect()), key=repr)
    assert got == plain_manifest(rows, fanout)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_and_of_none(spark):
    schema = "doc_id long, lang string, source string, n_chars long, text string"
    one = [(5, "en", "web", 3, "abc")]
    assert [tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame(one, schema)).collect()] == plain_manifest(one, 2)
    assert merkle_manifest.manifest(spark.createDataFrame([], schema)).count() == 0


def test_manifest_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    query, sql = merkle_manifest.QUERIES["op12_merkle_manifest"]
    names, want = sql_rows(con, sql)
    assert sorted((tuple(r) for r in query(spark, SF).select(*names).collect()), key=repr) == want


# ---------------------------------------------------------------- embeddings


def all_pairs(rows):
    """(vec_id, n_links, component_id, kept) by all cosines."""
    def unit(v):
        if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, float) / max(map(abs, v))
        return x / np.sqrt(x @ x)

    units = [unit(v) if i is not None else None for i, v in rows]
    near = [[] for _ in rows]
    groups = {}
    for n, u in enumerate(units):
        if u is not None:
            groups.setdefault(len(u), []).append(n)
    for members in groups.values():
        x = np.array([units[n] for n in members])
        for n, line in zip(members, x @ x.T >= 0.95):
            near[n] = [members[j] for j in np.flatnonzero(line) if members[j] != n]
    out, seen = [None] * len(rows), set()
    for n in range(len(rows)):
        if n in seen:
            continue
        reached, todo = {n}, [n]
        while todo:
            for j in near[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        seen |= reached
        least = min((rows[j][0] for j in reached), default=None) if rows[n][0] is not None else None
        for j in reached:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return sorted(out, key=repr)


def near_rows(spark, rows, **clash):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as c", "3 as u", "4 as key")
    return sorted((tuple(r) for r in embedding_near.near_duplicates(frame.repartition(8)).collect()), key=repr)


def test_near_embeddings_match_all_pairs(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(120):
        centre = draw.standard_normal(64)
        centre /= np.linalg.norm(centre)
        noise = (0.0, 0.005, 0.02, 0.03, 0.035)[i % 5]  # copies, tight groups, groups that are linked in part
        for _ in range(400 if i == 2 else (1, 2, 5, 25)[i % 4]):
            rows.append((len(rows), (centre + noise * draw.standard_normal(64)).tolist()))
    rows = [(int(i), v) for i, (_, v) in zip(draw.permutation(len(rows)), rows)]
    want = all_pairs(rows)
    assert near_rows(spark, rows) == want
    monkeypatch.setattr(embedding_near, "BLOCK", 8)
    monkeypatch.setattr(embedding_near, "SALT_ROWS", 2000)
    assert near_rows(spark, rows) == want  # hot buckets in blocks, centres by salt


def test_near_embeddings_odd_rows(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1e-300, 2e-300]),
        (9, [1e300, 2e300]), (10, [-1.0, -2.0]), (11, [3.0]), (12, [5.0]), (None, [1.0, 2.0]), (13, [1.0, 2.0, 0.0]), (14, [1.0, 2.2]),
    ]
    want = [(i, n, c, True if i is None else k) for i, n, c, k in all_pairs(rows)]
    assert near_rows(spark, rows) == sorted(want, key=repr)
    assert near_rows(spark, []) == []


def test_design_keeps_the_stated_recall():
    for count in (1000, 10**6, 10**9):
        k, tables = embedding_near.design(count, 64, 0.95, embedding_near.PROBES)
        chance = embedding_near.meeting_chance(64, 0.95, embedding_near.PROBES) ** k
        assert (1 - chance) ** tables <= embedding_near.MISS
    assert embedding_near.design(10**9, 64, 0.95, 2)[0] > embedding_near.design(1000, 64, 0.95, 2)[0]
