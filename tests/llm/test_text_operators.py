"""SentencePiece codec, chats, personal data and decontamination."""

import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from callwarden.llm import chat_format, decontaminate, pii, sentencepiece_codec
from callwarden.llm.common import blocks, column_bytes

from .conftest import ODD

# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.load(public_tokenizers.path(sentencepiece_codec.MODEL))


def test_ids_are_the_librarys(spark, model):
    codec = sentencepiece_codec.Codec(model)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    draw = random.Random(6)
    texts += ["".join(draw.choice(["the", "ing", " ", "▁", "é", "中", "😀", "\n", "th", "er", "a", "  "]) for _ in range(draw.randrange(30))) for _ in range(2000)]
    texts += [t or "" for _, t in ODD]
    ids, edges = codec.encode(texts)
    for text, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(text), text[:80]
        assert codec.decode(ids[a:b]) == text.replace("▁", " ")


def test_encoding_keeps_to_its_memory(model):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randrange(2, 16))) for _ in range(5000)]
    line = lambda: " ".join(draw.choices(words, k=500))
    batch = pa.RecordBatch.from_arrays([pa.array([line() for _ in range(1300)])], names=["text"])
    codec = sentencepiece_codec.Codec(model)
    tracemalloc.start()
    for block in blocks(iter([batch]), limit=sentencepiece_codec.TEXT_BYTES):
        codec.encode(block.column("text").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak


def test_unigram_search_finds_the_best_sum():
    draw = random.Random(7)
    pieces = ["<unk>", *"▁abc"] + sorted({"".join(draw.choice("▁abc") for _ in range(draw.randrange(2, 5))) for _ in range(25)})
    scores = np.array([0.0] + [-draw.random() * 9 for _ in pieces[1:]])
    kinds = np.array([2] + [1] * (len(pieces) - 1))
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Model(pieces, scores, kinds, sentencepiece_codec.UNIGRAM, True))

    def best(chunk):
        table = [0.0] + [-1e9] * len(chunk)
        for end in range(1, len(chunk) + 1):
            for start in range(end):
                if chunk[start:end] in pieces[1:]:
                    table[end] = max(table[end], table[start] + scores[pieces.index(chunk[start:end])])
        return table[-1]

    for length in range(1, 10):
        chunks = ["".join(draw.choice("▁abc") for _ in range(length)) for _ in range(40)]
        rows = codec.search(np.array([[ord(c) for c in chunk] for chunk in chunks], np.uint32))
        for chunk, row in zip(chunks, rows, strict=True):
            found = row[row >= 0]
            assert "".join(pieces[i] for i in found) == chunk and np.isclose(scores[found].sum(), best(chunk))


def test_codec_on_odd_tables(spark, odd, empty, model):
    rows = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(odd, model), model).collect()
    assert sorted((r.doc_id or -1, r.text) for r in rows if r.text is not None) == sorted((i or -1, t) for i, t in ODD if t is not None)
    assert [r.n_pieces for r in rows if r.doc_id == 1] == [0]
    assert sentencepiece_codec.encode_documents(empty, model).collect() == []


# ---------------------------------------------------------------- chats


def cheapest(roles):
    """Least cost by trying everything."""
    best = [10**9]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = cost
            return
        role = roles[i]
        for new in (1, 2, 3):
            if new in chat_format.NEXT[state]:
                go(i + 1, new, cost + (0 if new == role else 1 if role == 0 else 3))
            if new == role and any(new in chat_format.NEXT[b] for b in chat_format.NEXT[state]):
                go(i + 1, new, cost + 2)
        if state:
            go(i + 1, state, cost + (1 if state == role else 5))

    go(0, 0, 0)
    return best[0]


def test_repairs_are_cheapest_whole_and_in_parts():
    for length in range(1, 6):
        for roles in itertools.product(range(4), repeat=length):
            moves = chat_format.repair(list(roles))
            assert sum(m[0] for m in moves) == cheapest(roles)
            for cut in range(1, length):
                head, tail = list(roles[:cut]), list(roles[cut:])
                (_, a, b), (_, c, d) = chat_format._ways([(0, chat_format.costs(head)), (1, chat_format.costs(tail))])
                assert sum(m[0] for m in chat_format.repair(head, a, b) + chat_format.repair(tail, c, d)) == cheapest(roles)


def rendered(rows):
    by_conv = {}
    for r in sorted(rows, key=lambda r: r.place):
        by_conv[r.conv_id] = by_conv.get(r.conv_id, "") + r.segment
    return by_conv


def test_a_long_conversation_over_many_parts(spark):
    draw = random.Random(8)
    names = ["user", "assistant", "Human", " bot", "system", "tool", None]
    turns = [(1, i, draw.choice(names), f"t{i} <|end|>" if i % 9 else None) for i in range(400)]
    turns += [(c, i, draw.choice(names), f"c{c}") for c in range(2, 40) for i in range(draw.randrange(1, 6))]
    turns += [(2, 0, "user", "same"), (2, 0, "user", "same"), (None, 1, "user", "x"), (3, None, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as place")
    rows = chat_format.format_chats(frame).collect()
    assert len(rows) == len(turns) - 1
    for conv in {r.conv_id for r in rows}:
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.place)
        assert sum(r.cost for r in mine) == (sum(m[0] for m in chat_format.repair([chat_format.role_number(r.role) for r in mine])))
    for text in rendered(rows).values():
        roles = [chat_format.ROLES.index(r) + 1 for r in re.findall(r"<\|(system|user|assistant)\|>", text)]
        state = 0
        for role in roles:
            assert role in chat_format.NEXT[state]
            state = role
        assert text.count(chat_format.CLOSE) == len(roles) and text.endswith(chat_format.CLOSE)


def test_chat_rendering_of_repairs(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    moves = chat_format.repair([3, 3, 2, 2])
    assert "".join(chat_format.segments(moves, ["a", "b", "c", None], True, True)) == (
        "<|user|>\n\n<|end|>\n<|assistant|>\na\nb\n<|end|>\n<|user|>\nc\n\n<|end|>\n"
        if moves[0][4]
        else "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n\n<|end|>\n"
    )


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    return sorted(found + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])


def test_base_spans_match_the_patterns(spark):
    draw = random.Random(9)
    bits = ["1", "2", "25", ".", "@", "a", "b.c", "-", " ", "+", "4111 1111 1111 1111", "(", ")", "x@y.z", "+1 555 0123", "10.0.0.1", "\n", "é"]
    for _ in range(20000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(24)))
        assert pii.find(text)[0] == base_spans(text)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert pii.find(r.text) == (base_spans(r.text), [])


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("write to john at example dot com please", "email", "john at example dot com"),
        ("john.smith(at)mail.example(dot)org!", "email", "john.smith(at)mail.example(dot)org"),
        ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus four four two zero seven nine four six zero nine five eight", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("ip ４.３.２.１ ok", "ip", "４.３.２.１"),
        ("card ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ],
)
def test_disguised_spans_map_back(text, kind, source):
    base, added = pii.find(text)
    assert base == [] and [(pii.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, source)]


LONG = "a" * 300


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("dns eight dot eight dot eight dot eight ok", "ip", "eight dot eight dot eight dot eight"),
        ("host one nine two dot 168 dot oh dot one.", "ip", "one nine two dot 168 dot oh dot one"),
        ("host 10 dot 0 dot 0 dot 1 up", "ip", "10 dot 0 dot 0 dot 1"),
        ("dns eight.eight.eight.eight ok", "ip", "eight.eight.eight.eight"),
        ("call +44 two zero seven nine four six 0958 now", "phone", "+44 two zero seven nine four six 0958"),
        ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
        ("card four one one one 1111 1111 1111 ok", "card", "four one one one 1111 1111 1111"),
        ("card four one one one one one one one 1 one one one one one one one", "card", "four one one one one one one one 1 one one one one one one one"),
        ("write john dot smith at example dot com", "email", "john dot smith at example dot com"),
        ("write john dot four two at example dot com", "email", "john dot four two at example dot com"),
        (LONG + " at example dot com", "email", LONG + " at example dot com"),
        ("to john < at > example.com", "email", "john < at > example.com"),
        ("to john at example<.>com", "email", "john at example<.>com"),
    ],
)
def test_disguised_spans_of_any_length_and_mix(text, kind, source):
    base, added = pii.find(text)
    spans = [(pii.KINDS[k], text[a:b]) for a, k, b in base + added]
    assert (kind, source) in spans


@pytest.mark.parametrize("text", ["look at example.com", "we met at noon dot", "one two three", "at [dot] at", "a (at) b", "naïve café at dot"])
def test_plain_prose_has_no_spans(text):
    assert pii.find(text) == ([], [])


def test_long_runs_stay_linear():
    for text in ["a" * 10**6, "1" * 10**6, "@" * 10**5, "a." * 10**5 + "@", "one " * 10**5, "x at " * 10**5 + "dot", "+1" * 10**5, "1.1." * 10**5]:
        pii.find(text)


def test_pii_tables(odd, empty):
    assert len(pii.find_pii(odd).collect()) == len(ODD) and pii.find_pii(empty).collect() == []
    assert sorted(r.text for r in pii.redact(odd).collect() if r.text is not None) == sorted(t for _, t in ODD if t is not None)


# ---------------------------------------------------------------- decontamination

QUESTION = "Tom has 5 kg of apples and gives Mary 3 kg of them so how many kg does Tom still have now"


def held(text, items=(QUESTION,)):
    index = decontaminate.Index.build(list(range(len(items))), list(items))
    return [(i, n) for _, i, n, _ in index.matches(*column_bytes(pa.array([text], pa.string())))]


def test_reparameterised_questions_are_found():
    total = held(QUESTION)[0][1]
    other = QUESTION.replace("Tom", "Anna").replace("Mary", "Bob").replace("5", "17.5").replace("3", "4").replace("kg", "lb")
    assert held("We said. " + other + " Well.") == [(0, total)]
    mixed = QUESTION.replace("Tom", "Anna", 1)  # one value for two: the windows between don't count
    assert held(mixed) == [] or held(mixed)[0][1] < total
    assert held("They walk along the river and speak of many things that they still have to do") == [] == held(None) == held("")


RICE = "Tom has 5 kg of rice. Tom buys 3 kg more. Tom eats 2 kg of it. How many kg does Tom have left?"


@pytest.mark.parametrize("text", [RICE.replace("Tom", "Ann"), RICE.replace("Tom", "Ann").replace("kg", "lb").replace("5", "70"), RICE.upper(), RICE.lower()])
def test_names_and_units_are_placeholders_wherever_they_stand(text):
    ((_, total),) = held(RICE, [RICE])
    assert held("We said this.\n" + text + " Well.", [RICE]) == [(0, total)]


def test_an_item_in_capitals_has_windows():
    assert held(RICE.lower(), [RICE.upper()]) == held(RICE.upper(), [RICE.upper()]) != []


def test_other_words_in_the_same_frame_are_no_copy():
    assert held("Tom sees 5 men of rank. Tom asks 3 men more. Tom tells 2 men of it. How many men does Tom know here?", [RICE]) == []


SHORT = ["Who wrote Don Quixote?", "3 + 4 = 7, 5 + 6 = 11, 8 + 9 = 17", "Ann Bob Carl Dora Emil Frida Gus Hanna", "3 + 4 = 7, 5 + 6 = 12", "Who wrote Don Quixote?"]


def test_items_without_windows_are_found_whole():
    text = "He asked: who wrote DON QUIXOTE? Nobody knew.\n3 + 4 = 7, 5 + 6 = 11, 8 + 9 = 17\nann bob carl dora emil frida gus hanna"
    assert held(text, SHORT) == [(0, 1), (1, 1), (2, 1), (4, 1)]
    assert held("Who wrote Don Giovanni? 3 + 4 = 7, 5 + 6", SHORT) == [] == held("wrote Don Quixote", SHORT) == held("", SHORT)
    index = decontaminate.Index.build([0], SHORT[:1])
    assert index.matches(*column_bytes(pa.array(["Who wrote", "Don Quixote?", None, "who wrote Don Quixote"]))) == [(3, 0, 1, 0)]


def test_exact_items_in_a_table(docs):
    bench = docs([(7, SHORT[0]), (8, RICE)], clash=False).withColumnRenamed("doc_id", "item_id")
    rows = decontaminate.contaminated(docs([(1, "x. " + SHORT[0]), (2, "x")]), bench).collect()
    assert [tuple(r) for r in rows] == [(1, 7, 1, 1, 0)]


def test_decontamination_matches_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    squeeze = lambda t: " ".join(t.split())
    items = [(r.item_id, squeeze(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, text in items if text in squeeze(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and got == want
    small = decontaminate.benchmark_blocks(bench, block_chars=500)
    assert sorted(i for index in small for i in index.items.tolist()) == sorted(i for i, _ in items)


def test_decontamination_of_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, None), (None, "x y z"), (3, ""), (4, "one two three")], "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).collect() == [] == decontaminate.contaminated(empty, bench).collect()
    assert decontaminate.contaminated(odd, bench.where("item_id < 0")).collect() == []


def test_uncovered_spans_match_all_pairs():
    draw = random.Random(5)
    for _ in range(300):
        spans = lambda n: [(a := draw.randrange(12), draw.randrange(4), a + draw.randrange(1, 6)) for _ in range(n)]
        base, extra = spans(draw.randrange(8)), spans(draw.randrange(12))
        inside = lambda s, o: s[1] == o[1] and o[0] <= s[0] and s[2] <= o[2]
        want = sorted(s for s in set(extra) if not any(inside(s, o) for o in base) and not any(inside(s, o) and o != s for o in extra))
        assert pii.uncovered(base, extra) == want


def test_many_finds_stay_linear():
    text = "an \u2013 " + "".join(f"user{i}@host{i}.example " for i in range(40_000))
    begin = time.perf_counter()
    base, added = pii.find(text)
    assert len(base) == 40_000 and not added and time.perf_counter() - begin < 20
