"""Token ids in directly addressable codes, written and read back by Spark.

Text is encoded by a public tokenizer, the end id is appended to every document, and the ids are
stored in ascending ``doc_id`` order. A store is a folder of Parquet files written through Spark's
committer (so lost or repeated tasks leave nothing behind and any store Spark knows will do), one
row per shard: index columns (part, shard, doc_ids, doc_tokens, n_tokens) and ``codes``, the
self-describing binary of the shard. A range-partitioned part holds ascending documents, and its
shards are numbered in order.

Layout of ``codes``, all integers little-endian::

    magic 'DAC1' | u8 chunk bits (8) | u8 levels | u16 0 | per level: u32 entries
    per level: chunk bytes (entries) | continuation bitmap (ceil(entries/8), bit i%8 of byte i//8)
               | rank directory (u32 set bits before each 512-bit block)

Level 0 has the low 8 bits of every id; a set continuation bit means that more bits of the id
follow in the next level at position rank(bit). ``get`` reads one id from its own chunks, bitmap
bits and directory entries; no block is decoded.

Defined cases: NULL text is empty; an empty text is stored as its end id alone. Rows that share a
``doc_id`` lie side by side, ordered by text. NULL ids come first.
"""

from __future__ import annotations

import array
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callwarden.llm.common import documents, ensure_checkpoint_dir, map_arrow

END_ID = 0
SHARD_TOKENS = 1 << 18
RANK_BITS = 512
TOKENIZER = "byte_bpe_50k.json"
#: Distinct pre-tokens a task remembers before it starts anew.
REMEMBERED = 300_000
#: Texts beyond these letters go to the library whole: Unicode tables may differ by version.
LATIN_END = 0x250


def _latin(kind: str) -> str:
    """Members of a Unicode category among the Latin letters' code points, for a character class."""
    return re.escape("".join(chr(c) for c in range(LATIN_END) if unicodedata.category(chr(c)).startswith(kind)))


_L, _N, _S = _latin("L"), _latin("N"), "\t\n\x0b\x0c\r \x85\xa0"
#: The pre-tokens of byte-level vocabularies: contractions, letters, numbers, others, white space.
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _byte_letters() -> dict[int, str]:
    """Printable stand-in of every byte: itself where it prints, else the next letter from U+0100."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids of pre-tokens; an unknown one is encoded when it is first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin1").translate(self.letters))
        found = self[word] = array.array("I", [t.id for t in tokens]).tobytes()
        return found


class Encoder:
    """Ids by the tokenizers library, asked once for each distinct pre-token.

    Byte-level BPE never merges across pre-tokens, so the ids of a text are those of its
    pre-tokens in order. Texts that hold an added token (such as ``<|endoftext|>``), which the library
    cuts out first, and vocabularies with another pre-tokenizer are encoded whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        known = json.loads(spec)
        pre = known.get("pre_tokenizer") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not known.get("normalizer")
            and known["model"]["type"] == "BPE"
        )
        added = [re.escape(t["content"]) for t in known.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(added)) if added else None
        self.seen = _Words(self.tokenizer.model)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._library(texts)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        out, whole = [], []
        for i, text in enumerate(texts):
            by_word = (text.isascii() or ord(max(text)) < LATIN_END) and not (self.added and self.added.search(text))
            if not by_word:
                whole.append(i)
            out.append(b"".join(map(self.seen.__getitem__, PRE_TOKEN.findall(text))) if by_word else b"")
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


# ---------------------------------------------------------------- codes


def pack(ids: np.ndarray) -> bytes:
    """Codes of an array of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while not levels or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        set_before = np.concatenate([[0], np.cumsum(more)])[:-1:RANK_BITS] if len(more) else np.empty(0)
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8), bits, set_before.astype("<u4")))
        rest = rest[more] >> 8
    head = b"DAC1" + struct.pack("<BBH", 8, len(levels), 0) + b"".join(struct.pack("<I", x[0]) for x in levels)
    return head + b"".join(part.tobytes() for x in levels for part in x[1:])


class Codes:
    """Reader of one shard's codes."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1" or data[4] != 8:
            raise ValueError("not directly addressable codes of 8-bit chunks")
        counts = struct.unpack_from(f"<{data[5]}I", data, 8)
        at, self.levels = 8 + 4 * data[5], []
        for n in counts:
            chunk = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at + n)
            blocks = -(-n // RANK_BITS)
            ranks = np.frombuffer(data, "<u4", blocks, at + n + len(bits))
            self.levels.append((chunk, bits, ranks))
            at += n + len(bits) + 4 * blocks
        self.size = counts[0]

    @staticmethod
    def rank(level: tuple, i: int) -> int:
        """Set continuation bits before position i."""
        chunk, bits, ranks = level
        if i >= len(chunk) and i % RANK_BITS == 0:
            return Codes.rank(level, i - 1) + (int(bits[(i - 1) // 8]) >> ((i - 1) % 8) & 1) if i else 0
        block = i // RANK_BITS
        within = np.bitwise_count(bits[block * RANK_BITS // 8 : i // 8]).sum(dtype=np.int64)
        last = int(bits[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[block]) + int(within) + last.bit_count()

    def get(self, i: int) -> int:
        """Id at position i."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for level in self.levels:
            chunk, bits, _ = level
            value |= int(chunk[i]) << shift
            if not int(bits[i // 8]) >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids of positions start to end, by the chunks of these positions alone."""
        out = np.zeros(max(end - start, 0), np.uint32)
        at = np.arange(len(out))
        for depth, level in enumerate(self.levels):
            if end <= start:
                break
            chunk, bits, _ = level
            out[at] |= chunk[start:end].astype(np.uint32) << (8 * depth)
            more = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start]
            start = self.rank(level, start)
            at = at[more.astype(bool)]
            end = start + len(at)
        return out


# ---------------------------------------------------------------- writing and reading

STORE = "part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, codes binary"


def _writer(spec: str, end_id: int, shard_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("codes", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, end = Encoder(spec), np.array([end_id], "<u4").tobytes()
        names: list = []
        held: list[bytes] = []
        count = shard = 0

        def shut() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [shard], [len(ids)], [names], [[len(x) // 4 for x in held]], [pack(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    names.append(doc_id)
                    held.append(ids + end)
                    count += len(ids) // 4 + 1
                    if count >= shard_tokens:
                        yield shut()
                        names, held, count, shard = [], [], 0, shard + 1
        if held:
            yield shut()

    return write


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) by the tokenizer file and write the store to a new folder."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(ranged, _writer(spec, end_id, shard_tokens), STORE).write.option("compression", "none").parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """(part, shard, shard_start): ids in all shards before, from the index columns alone.

    Sums of parts first, one row each, then running sums inside every part.
    """
    index = store.select("part", "shard", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard")
    running = index.select("part", "shard", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("in_start"))
    return running.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("in_start")).alias("shard_start"))


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, edges = Codes(row["codes"]), np.concatenate([[0], np.cumsum(row["doc_tokens"])]).astype(np.int64)
            ids = codes.slice(0, codes.size).astype("<u4")
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            count = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * count, pa.int32()), pa.array([row["shard"]] * count, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(edges[:-1]), pa.array(np.diff(edges)), pa.array(crcs, pa.int64())],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the stored codes."""
    rows = store.select("part", "shard", "doc_ids", "doc_tokens", "codes")
    read = map_arrow(rows, _read_documents, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    placed = read.join(shard_starts(store), ["part", "shard"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(store: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token_id) of the global positions asked for: shards are found by their start,
    and each id is read from its own chunks."""
    spans = store.join(shard_starts(store), ["part", "shard"]).select("shard_start", "n_tokens", "codes")
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct()
    width = SHARD_TOKENS
    cells = spans.withColumn("cell", F.explode(F.expr(f"sequence(shard_start div {width}, (shard_start + n_tokens - 1) div {width})")))
    found = wanted.withColumn("cell", F.expr(f"position div {width}")).join(cells, "cell")
    found = found.where("position >= shard_start and position < shard_start + n_tokens")
    asked = found.groupBy("shard_start").agg(F.collect_list(F.col("position") - F.col("shard_start")).alias("at"))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["codes"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard_start"] + i for i in row["at"]], pa.int64()), pa.array([codes.get(i) for i in row["at"]], pa.int64())],
                    names=["position", "token_id"],
                )

    return map_arrow(spans.join(asked, "shard_start").select("shard_start", "at", "codes"), get, "position long, token_id long")


def new_store_path(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_store_path(spark)
    write_store(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return read_documents(spark.read.parquet(path))


QUERIES = {"op5_token_store": (op5_token_store, None)}
