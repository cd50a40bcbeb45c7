"""Line dedup and token store."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from callwarden.llm import line_dedup, token_store

from .conftest import ODD

SPACES = " \t\n\x0b\x0c\r"


def kept_lines(rows, least=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACES).translate(fold)
    owner = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= least:
                owner[key(line)] = min(owner.get(key(line), doc_id), doc_id)
    return [
        (doc_id, text, "\n".join(x for x in (text or "").split("\n") if doc_id is None or owner.get(key(x), doc_id) == doc_id))
        for doc_id, text in rows
    ]


def dedup(frame):
    out = line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame))
    return sorted(((r.row.doc_id, r.row.text, r.kept, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)


def test_line_dedup_matches_brute_force(docs):
    draw = random.Random(5)
    lines = ["A shared line of text", "  a SHARED line of text\r", "short", "another shared line\t", "Ärger über ÄÖÜ lines", ""]
    rows = [(i // 2 if i > 190 else i, "\n".join(draw.choice([*lines, f"own line number {i}", f"pair of lines {i // 3}"]) for _ in range(draw.randrange(150)))) for i in range(200)]
    rows += ODD
    want = sorted(((d, t, k, len((t or "").split("\n")), len((t or "").split("\n")) - (len(k.split("\n")) if k or (t or "") == "" else 0)) for d, t, k in kept_lines(rows)), key=repr)
    got = dedup(docs(rows))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for (doc, text, kept, n_lines, n_dropped) in got:
        whole = (text or "").split("\n")
        assert n_dropped in (n_lines - len(kept.split("\n")), n_lines if kept == "" else -1), (doc, whole[:3])


def test_frequent_lines_take_the_broadcast_way(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 4)
    rows = [(i, "the line that all of them have\nand my own line %d" % i) for i in range(60)]
    assert [(d, t, k) for d, t, k, _, _ in dedup(docs(rows))] == sorted(kept_lines(rows), key=repr)


def test_line_dedup_bitmaps_are_sparse(docs):
    rows = [(1, "a line that is repeated"), (2, "\n".join(["%d own" % i for i in range(1000)] + ["a line that is repeated"]))]
    (row,) = line_dedup.keep_bitmaps(docs(rows)).collect()
    assert (row.doc_id, row.n_dropped, len(row.keep)) == (2, 1, 1)
    assert (row.keep[0].word, row.keep[0].mask) == (1000 // 64, ~(1 << 1000 % 64))


def test_line_dedup_empty_table_and_stage(spark, empty, odd):
    assert dedup(empty) == []
    assert line_dedup.dedup_stage(spark, odd, "").columns == odd.columns


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path(token_store.TOKENIZER), encoding="utf-8") as file:
        return token_store.Encoder(file.read())


def test_encoder_gives_the_librarys_ids(encoder):
    draw = random.Random(1)
    letters = [" ", "\n", "'", "s", "é", "²", "1", "\x85", "\xa0", "\x1c", "-", "T", "ʼ", "ª", "ll", "　", "中", "😀", "ɐ"]
    texts = ["".join(draw.choice(letters) for _ in range(60)) for _ in range(500)]
    texts += ["".join(map(chr, range(token_store.LATIN_END))), "", "<|endoftext|> it's"]
    assert encoder.by_word and encoder.encode(texts) == encoder._library(texts)


def test_added_tokens_keep_the_librarys_ids(encoder):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "it's <|endoftext|><|endoftext|>\n  two", "<|endoftext", "é中 <|endoftext|>", "plain text", ""]
    texts += [f"x {t.content} y" for t in fresh.get_added_tokens_decoder().values()]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and len(want[0]) == 4 * 4


@pytest.mark.parametrize("count", [0, 1, 7, 8, 511, 512, 513, 1024, 5000])
def test_codes_round_trip_and_random_access(count):
    draw = np.random.default_rng(count)
    ids = draw.integers(0, 1 << 24, count)
    ids[::3] = draw.integers(0, 256, len(ids[::3]))
    codes = token_store.Codes(token_store.pack(ids))
    assert codes.size == count and codes.slice(0, count).tolist() == ids.tolist()
    assert [codes.get(i) for i in range(count)] == ids.tolist()
    for a, b in [(0, 0), (count // 3, count // 2), (count // 2, count)]:
        assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        codes.get(count)


def test_store_holds_all_documents_in_order(spark, docs, encoder):
    rows = [r for r in ODD if r[0] is not None] + [(i, f"text number {i} " * (i % 40)) for i in range(20, 300)]
    path = token_store.new_store_path(spark)
    token_store.write_store(docs(rows), path, public_tokenizers.path(token_store.TOKENIZER), shard_tokens=500)
    store = spark.read.parquet(path)
    at, want, flat = 0, [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = encoder._library([text or ""])[0] + b"\0\0\0\0"
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
        flat += np.frombuffer(ids, "<u4").tolist()
    assert sorted(map(tuple, token_store.read_documents(store).collect())) == sorted(want)
    asked = spark.range(0, len(flat), 97).withColumnRenamed("id", "position")
    got = {r.position: r.token_id for r in token_store.read_tokens(store, asked).collect()}
    assert got == {i: flat[i] for i in range(0, len(flat), 97)}


def test_store_of_no_documents(spark, empty):
    path = token_store.new_store_path(spark)
    token_store.write_store(empty, path, public_tokenizers.path(token_store.TOKENIZER))
    assert token_store.read_documents(spark.read.parquet(path)).collect() == []


