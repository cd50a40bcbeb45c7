"""SentencePiece encoding and decoding with the library's ids, by a batched Viterbi search.

A text is normalised (a dummy prefix, blanks as U+2581) and cut into chunks before every blank
that follows another character; no piece of a vocabulary of this kind crosses such a cut. Distinct
chunks of equal length advance together through the lattice of their substrings: for every end
position the hashes of all substrings that end there probe the sorted keys of the pieces, and the
maximum over them is stored with its back pointer.

The score of a path depends on the model:

* unigram: the sum of the pieces' scores;
* BPE: merge order, not a sum, decides there, and the sums alone give other ids than the library.
  A segmentation is the BPE one if every piece and every pair of neighbours is left as it is when
  merged on its own, so a step is legal if the best piece of the prefix and the new piece are such
  a pair. Pairs are tried by batched merging once and remembered; the maximum runs over legal steps. A
  chunk without a legal path is merged directly, so each text gets its ids in any case.

Characters without a piece become byte pieces, or the unknown piece in models without these.

Defined cases: NULL text has NULL ids and decodes to NULL; an empty text has no ids. U+2581 in a
text comes back as a blank, the only loss of models with byte pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.common import U64, blocks, documents, map_arrow, mix

MODEL = "piece_bpe_32k.model"
BLANK = 0x2581
#: Text of a block; the larger, the more chunks of it are alike and the more memory a worker takes.
TEXT_BYTES = 2 << 20
#: Slots of the table of tried pairs; a later pair of the same slot takes its place.
PAIR_SLOTS = 1 << 21
#: Distinct chunks that a worker remembers before it starts anew.
KNOWN_CHUNKS = 250_000
#: Cells (chunks x positions) of the lattices advanced at once.
CELLS = 1 << 18
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 1 << 64)


# ---------------------------------------------------------------- model files


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, struct.unpack("<f", data[at : at + 4])[0] if size == 4 else data[at : at + 8]
            at += size


@dataclass
class Model:
    """Pieces, scores and kinds of a model file."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    algorithm: int
    prefix: bool

    @classmethod
    def load(cls, data: bytes) -> Model:
        pieces, scores, kinds, algorithm, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models without character maps and blank removal are supported")
        if algorithm not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, np.array(scores), np.array(kinds), algorithm, prefix)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _prefix_hashes(chunks: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of the rows of a matrix of code points."""
    length = chunks.shape[1]
    out = np.zeros((len(chunks), length + 1), np.uint64)
    np.cumsum(mix(chunks.astype(np.uint64) + U64(1)) * _powers(_P, length), axis=1, out=out[:, 1:])
    return out


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:count]


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: Model):
        self.model = model
        self.algorithm = model.algorithm
        usable = np.flatnonzero(np.isin(model.kinds, [_NORMAL, _USER]))
        codes = [_code_points(model.pieces[i]) for i in usable]
        self.longest = max(map(len, codes), default=1)
        self.down = _powers(_Q, 1)
        hashes = np.array([_prefix_hashes(c[None])[0, -1] for c in codes], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], usable[order].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)  # by the upper 20 bits of a key
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True
        self.scores = model.scores
        self.codes = dict(zip(usable.tolist(), codes, strict=True))
        self.outside = len(model.pieces)  # stands for a character without a piece
        self.sizes = np.ones(self.outside + 1, np.int64)
        self.sizes[usable] = [len(c) for c in codes]
        self.unknown_score = float(self.scores[usable].min(initial=0)) - 10
        unknown = np.flatnonzero(model.kinds == _UNKNOWN)
        self.unknown = int(unknown[0]) if len(unknown) else 0
        self.bytes = {int(model.pieces[i][1:-1], 16): int(i) for i in np.flatnonzero(model.kinds == _BYTE)}
        self.pairs, self.legal = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, bool)
        self.chunks: dict[int, bytes] = {}
        self.whole = np.zeros(self.outside + 1, bool)
        if self.algorithm == BPE:
            self.whole[self.outside] = True
            for length in {len(c) for c in codes}:
                some = [i for i, c in self.codes.items() if len(c) == length]
                merged = self.merge(np.array([self.codes[i] for i in some]))
                self.whole[some] = (merged[:, 1:] == -1).all(axis=1) & (merged[:, 0] == some)
        table = [p.replace("▁", " ").encode() for p in model.pieces]
        for value, piece in self.bytes.items():
            table[piece] = bytes([value])
        for piece in np.flatnonzero(np.isin(model.kinds, [_CONTROL])):
            table[piece] = b""
        table[self.unknown] = " ⁇ ".encode()
        self.table = table

    # ------------------------------------------------------------ lattice

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        out = np.full(hashes.shape, -1)
        some = np.nonzero(self.maybe[(hashes >> U64(44)).astype(np.int64)])
        ask = hashes[some]
        at = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == ask, self.ids[at], -1)
        return out

    def _inverse(self, count: int) -> np.ndarray:
        if len(self.down) < count:
            self.down = _powers(_Q, count)
        return self.down

    def merge(self, chunks: np.ndarray) -> np.ndarray:
        """Pieces of each row by merging its best neighbours, leftmost first; padded with -1."""
        count, length = chunks.shape
        hashes, down = _prefix_hashes(chunks), self._inverse(length + 1)
        out = np.full((count, length), -1, np.int64)
        rows = np.arange(count)
        starts = np.broadcast_to(np.arange(length + 1), (count, length + 1))
        while len(rows):
            size = starts.shape[1] - 1
            if size > 1:
                a, b = starts[:, :-2], starts[:, 2:]
                found = self._probe((hashes[rows[:, None], b] - hashes[rows[:, None], a]) * down[a])
                score = np.where(found >= 0, self.scores[found], -np.inf)
                best = score.argmax(axis=1)
                going = score[np.arange(len(rows)), best] > -np.inf
            else:
                best, going = np.zeros(len(rows), int), np.zeros(len(rows), bool)
            done = rows[~going]
            a, b = starts[~going, :-1], starts[~going, 1:]
            found = self._probe((hashes[done[:, None], b] - hashes[done[:, None], a]) * down[a])
            out[done, :size] = np.where(found < 0, self.outside, found)
            keep = np.ones((int(going.sum()), size + 1), bool)
            keep[np.arange(len(keep)), best[going] + 1] = False
            rows, starts = rows[going], starts[going][keep].reshape(-1, size)
        return out

    def _legal(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as it is."""
        code = left * (self.outside + 1) + right
        slot = (mix(code.astype(np.uint64)) >> U64(65 - PAIR_SLOTS.bit_length())).astype(np.int64)
        out = self.legal[slot]
        missing = np.flatnonzero(self.pairs[slot] != code)
        if len(missing):
            fresh, where, which = np.unique(code[missing], return_index=True, return_inverse=True)
            verdict = self._try(*np.divmod(fresh, self.outside + 1))
            out[missing] = verdict[which]
            place = slot[missing[where]]
            self.pairs[place], self.legal[place] = fresh, verdict
        return out

    def _try(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair as it is, by merging it."""
        verdict = np.ones(len(a), bool)
        real = np.flatnonzero((a < self.outside) & (b < self.outside))
        sizes = self.sizes[a[real]] + self.sizes[b[real]]
        for low, high in ((0, 9), (9, 15), (15, 2 * self.longest)):
            some = real[(sizes > low) & (sizes <= high)]
            if len(some):  # blanks of code 0 fill the rows up; they are in no piece
                rows = np.zeros((len(some), int((self.sizes[a[some]] + self.sizes[b[some]]).max())), np.uint32)
                for row, x, y in zip(rows, a[some].tolist(), b[some].tolist(), strict=True):
                    left, right = self.codes[x], self.codes[y]
                    row[: len(left)] = left
                    row[len(left) : len(left) + len(right)] = right
                merged = self.merge(rows)
                verdict[some] = (merged[:, 0] == a[some]) & (merged[:, 1] == b[some])
        return verdict

    def search(self, chunks: np.ndarray) -> np.ndarray:
        """Pieces of each row (chunks of one length) by the best path; padded with -1."""
        count, length = chunks.shape
        hashes, down = _prefix_hashes(chunks), self._inverse(length + 1)
        score = np.full((count, length + 1), -np.inf)
        score[:, 0] = 0
        piece = np.full((count, length + 1), -1, np.int64)
        back = np.zeros((count, length + 1), np.int32)
        rows = np.arange(count)
        for end in range(1, length + 1):
            first = max(end - self.longest, 0)
            starts = np.arange(first, end)
            found = self._probe((hashes[:, end : end + 1] - hashes[:, first:end]) * down[starts])
            lone = found[:, -1] < 0
            found[lone, -1] = self.outside
            if self.algorithm == UNIGRAM:
                gain = np.where(found >= 0, np.append(self.scores, self.unknown_score)[found], -np.inf)
                total = score[:, first:end] + gain
            else:
                # one legal step at most leads to each end; the longer one would win a tie
                total = np.where((found >= 0) & self.whole[found] & (score[:, first:end] > -np.inf), (end - starts).astype(float), -np.inf)
                x, y = np.nonzero((total > -np.inf) & (starts > 0))
                bad = ~self._legal(piece[x, y + first], found[x, y])
                total[x[bad], y[bad]] = -np.inf
            best = total.argmax(axis=1)
            score[:, end] = total[rows, best]
            piece[:, end] = found[rows, best]
            back[:, end] = first + best
        out = np.full((count, length), -1, np.int64)
        at, place = np.full(count, length), np.full(count, length)
        live = np.flatnonzero(score[:, length] > -np.inf)
        while len(live):
            place[live] -= 1
            out[live, place[live]] = piece[live, at[live]]
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        lost = np.flatnonzero(score[:, length] == -np.inf)
        if len(lost):
            out[lost] = self.merge(chunks[lost])
        return out

    # ------------------------------------------------------------ texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and of the end)."""
        joined = [("▁" if self.model.prefix else "") + t.replace(" ", "▁") if t else "" for t in texts]
        text_edges = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
        codes = _code_points("".join(joined))
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        blank = codes == BLANK
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[text_edges[text_edges < len(codes)]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(codes)))
        names = self._names(codes, starts, lengths)
        names, kinds, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.chunks) > KNOWN_CHUNKS:
            self.chunks = {}
        names = names.tolist()
        new = [i for i, n in enumerate(names) if n not in self.chunks]
        fresh = kinds[new]
        self.chunks.update(zip([names[i] for i in new], self._distinct(codes, starts[fresh], lengths[fresh]), strict=True))
        found = [self.chunks[n] for n in names]
        of = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), np.int32), np.cumsum(of) - of
        sizes = of[which]
        ends = np.cumsum(sizes)
        out = ids[np.arange(int(ends[-1])) + np.repeat(first[which] - ends + sizes, sizes)]
        edges = np.append(0, ends)[np.searchsorted(starts, text_edges)]
        return out, edges

    def _names(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hash of each chunk."""
        out = np.empty(len(starts), np.uint64)
        for first in range(0, len(starts), 1 << 16):
            a, n = starts[first : first + (1 << 16)], lengths[first : first + (1 << 16)]
            part = codes[a[0] : a[-1] + n[-1]]
            sums = np.concatenate([[U64(0)], np.cumsum(mix(part.astype(np.uint64) + U64(1)) * _powers(_P, len(part)))])
            low = a - a[0]
            out[first : first + len(a)] = mix((sums[low + n] - sums[low]) * self._inverse(len(part) + 1)[low] + n.astype(np.uint64))
        return out

    def _distinct(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Ids of each of these distinct chunks, as 32-bit integers."""
        found = [b""] * len(starts)
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            step = max(CELLS // int(length), 1)
            for at in range(0, len(same), step):
                some = same[at : at + step]
                rows = self.search(codes[starts[some][:, None] + np.arange(length)])
                odd = np.flatnonzero((rows == self.outside).any(axis=1))
                flat, ends = rows[rows >= 0].astype(np.int32).tobytes(), (4 * np.cumsum((rows >= 0).sum(axis=1))).tolist()
                for k, a, b in zip(some.tolist(), [0, *ends[:-1]], ends, strict=True):
                    found[k] = flat[a:b]
                for k in some[odd].tolist():
                    found[k] = self._fall_back(codes[starts[k] :][:length], np.frombuffer(found[k], np.int32)).tobytes()
        return found

    def _fall_back(self, chunk: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Ids with characters that have no piece as bytes, or as one unknown piece for a run."""
        out: list[int] = []
        at = 0
        for piece in ids.tolist():
            if piece != self.outside:
                out.append(piece)
                at += len(self.codes[piece])
                continue
            if self.bytes:
                out += [self.bytes[b] for b in chr(int(chunk[at])).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += 1
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; broken byte sequences become U+FFFD."""
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


# ---------------------------------------------------------------- Spark


def load(path: str) -> Model:
    with open(path, "rb") as file:
        return Model.load(file.read())


_codecs: dict[int, Codec] = {}


def codec_of(model: Model) -> Codec:
    """Codec of a model, kept by the worker between tasks."""
    name = hash((tuple(model.pieces), model.scores.tobytes()))
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(model)
    return _codecs[name]


def encode_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for block in blocks(batches, limit=TEXT_BYTES):
            texts = block.column("text")
            ids, edges = codec.encode([t or "" for t in texts.to_pylist()])
            missing = texts.is_null() if texts.null_count else None
            rows = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids), mask=missing)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), rows], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_pieces, ids_hash, text) of rows with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [None if not row.is_valid else codec.decode(row.values.to_numpy()) for row in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.select(["doc_id", "n_pieces", "ids_hash"]).columns, pa.array(texts, pa.string())], names=["doc_id", "n_pieces", "ids_hash", "text"])

    sized = encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "ids")
    return map_arrow(sized, run, "doc_id long, n_pieces long, ids_hash long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    import public_tokenizers

    model = load(public_tokenizers.path(MODEL))
    decoded = decode_documents(encode_documents(documents(spark, sf_dir), model), model)
    return decoded.select("doc_id", "n_pieces", "ids_hash", F.sha2(F.col("text"), 256).alias("text_sha256"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of what the earlier stages kept."""
    import public_tokenizers

    return encode_documents(docs, load(public_tokenizers.path(MODEL)))


QUERIES = {"op2_sentencepiece": (op2_sentencepiece, None)}
