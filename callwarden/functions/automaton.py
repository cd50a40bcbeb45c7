"""Numbers cut into fragments, put together by a finite automaton instead of all orders.

One automaton reads digits and knows every number shape: mobile prefixes and the count of digits. A
fragment is the map it makes of states to states, written as a text with one letter for each state, so
following one digit is ``translate`` and following a fragment is one look-up. Pairs and triples are
then joined on states: for each state only the few fragments that reach it are kept, just enough to
avoid using one twice, so the work is linear in the fragments.
"""

from __future__ import annotations

from functools import cache

from callwarden.functions import patterns as P
from callwarden.functions import sqlx as F
from callwarden.functions.decode import bound, let
from callwarden.functions.sqlx import E as Column

#: Longest number that is no mobile number.
LONGEST = 19
#: Up to so many digit strings are put together one by one, which costs less than the automaton.
FEW = 8
#: Leading zeros beyond these change no state.
ZEROS = 24


def _mobile_step(states: frozenset, digit: int) -> frozenset:
    """Subset step of ``(0086|00|86|0)?0*1[3-9]\\d{9}``; numbers count the digits read from the 1 on."""
    out = set()
    for s in states:
        if s in ("start", "zeros", "o", "oo") and digit == 0:
            out.add("zeros")
        if s in ("start", "zeros", "o", "oo") and digit == 1:
            out.add(1)
        if s == "start" and digit == 0:
            out.add("o")
        if s == "o" and digit == 0:
            out.add("oo")
        if s in ("start", "oo") and digit == 8:
            out.add("eight")
        if s == "eight" and digit == 6:
            out.add("zeros")
        if s == 1 and digit >= 3:
            out.add(2)
        if isinstance(s, int) and 2 <= s < 11:
            out.add(s + 1)
    return frozenset(out)


@cache
def machine() -> tuple[str, tuple[str, ...], dict[str, str], str]:
    """(letters of the states, their successors for each digit, shape of accepting letters, dead letter)."""
    first = (frozenset(["start"]), 0)
    numbers, order, steps = {first: 0}, [first], []
    for states, length in order:
        row = []
        for digit in range(10):
            after = (_mobile_step(states, digit), min(length + 1, LONGEST + 1))
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            row.append(numbers[after])
        steps.append(row)
    letter = lambda n: chr(0x3400 + n)
    shapes = {}
    for n, (states, length) in enumerate(order):
        if 11 in states and length >= 11:
            shapes[letter(n)] = "mobile"
        elif length == 18:
            shapes[letter(n)] = "idcard"
        elif 16 <= length <= LONGEST:
            shapes[letter(n)] = "bankcard"
    letters = "".join(map(letter, range(len(order))))
    following = tuple("".join(letter(row[digit]) for row in steps) for digit in range(10))
    return letters, following, shapes, letter(numbers[(frozenset(), LONGEST + 1)])


@bound
def effect(digits: Column) -> Column:
    """Map of states that a digit string makes."""
    letters, following, _, dead = machine()

    def step(now: Column, digit: Column) -> Column:
        out = now
        for d in range(9, -1, -1):
            out = F.when(digit == str(d), F.translate(now, letters, following[d])).otherwise(out)
        return out

    short = F.regexp_replace(digits, f"^0{{{ZEROS},}}", "0" * ZEROS)
    hopeless = F.length(F.regexp_replace(digits, "^0+", "")) > LONGEST + 1
    return F.when(hopeless, dead * len(letters)).otherwise(F.aggregate(F.split(short, ""), F.lit(letters), step))


def _after(effects: Column, state: Column) -> Column:
    return F.substr(effects, F.position(state, F.lit(machine()[0])), F.lit(1))


def _best(states: Column) -> Column:
    """Name of the first shape, in the order mobile, idcard, bankcard, among states."""
    _, _, shapes, _ = machine()
    name = F.lit(None).cast("string")
    for shape in ("bankcard", "idcard", "mobile"):
        letters = "".join(c for c, s in shapes.items() if s == shape)
        name = F.when(F.exists(states, lambda s: F.contains(F.lit(letters), s)), shape).otherwise(name)
    return name


def _alive(state: Column) -> Column:
    return state != machine()[3]


def joined_shape(fragments: Column, triples: bool = True) -> Column:
    """Shape of a number that two or three different fragments make, in any order; NULL if none.

    ``fragments`` is an array of arrays: the digit strings each fragment may be read as. An empty
    string is a fragment that changes nothing. Pairs come before triples.
    """
    at = lambda i, e: F.struct(i.alias("i"), e.alias("effect"))
    entries = F.flatten(F.transform(fragments, lambda readings, i: F.transform(readings, lambda d: at(i, effect(d)))))
    states = lambda c: F.array_distinct(F.transform(c, lambda p: p["state"]))

    def joined(all_: Column) -> Column:
        once = F.filter(F.transform(all_, lambda e: F.struct(_after(e["effect"], F.lit(machine()[0][0])).alias("state"), e["i"].alias("i"))), lambda p: _alive(p["state"]))

        def with_who(once_: Column) -> Column:
            """For each state up to three fragments that lead to it."""
            who = lambda s: F.slice(F.array_distinct(F.transform(F.filter(once_, lambda p: p["state"] == s), lambda p: p["i"])), 1, 3)
            return F.transform(states(once_), lambda s: F.struct(s.alias("state"), who(s).alias("who")))

        def pairs(reached: Column) -> Column:
            def extended(r: Column, e: Column) -> Column:
                firsts = F.slice(F.filter(r["who"], lambda i: i != e["i"]), 1, 2)
                return F.transform(firsts, lambda i: F.struct(_after(e["effect"], r["state"]).alias("state"), i.alias("i"), e["i"].alias("j")))

            every = F.flatten(F.transform(reached, lambda r: F.flatten(F.transform(all_, lambda e: extended(r, e)))))
            return F.filter(every, lambda p: _alive(p["state"]))

        def few(mine: Column) -> Column:
            """Up to three pairs, so that one avoids any given fragment if any pair does."""
            without = lambda i: F.slice(F.filter(mine, lambda p: (p["i"] != i) & (p["j"] != i)), 1, 1)
            first = F.get(mine, 0)
            return F.concat(F.slice(mine, 1, 1), without(first["i"]), without(first["j"]))

        def thirds(pairs_: Column) -> Column:
            kept = F.flatten(F.transform(states(pairs_), lambda s: let(F.filter(pairs_, lambda p: p["state"] == s), few)))
            others = lambda p: F.filter(all_, lambda e: (e["i"] != p["i"]) & (e["i"] != p["j"]))
            return F.array_distinct(F.flatten(F.transform(kept, lambda p: F.transform(others(p), lambda e: _after(e["effect"], p["state"])))))

        def named(pairs_: Column) -> Column:
            two = let(states(pairs_), _best)
            return F.coalesce(two, let(thirds(pairs_), _best)) if triples else two

        return let(let(let(once, with_who), pairs), named)

    def put_together(texts: Column) -> Column:
        long = F.filter(texts, lambda t: F.length(t) >= 11)
        return let(
            long,
            lambda ts: F.when(F.exists(ts, lambda t: t.rlike(f"^{P.MOBILE}\\z")), "mobile")
            .when(F.exists(ts, lambda t: F.length(t) == 18), "idcard")
            .when(F.exists(ts, lambda t: F.length(t).between(16, LONGEST)), "bankcard"),
        )

    def one_by_one(few: Column) -> Column:
        others = lambda p: F.filter(few, lambda e: ~F.array_contains(p["who"], e["i"]))
        longer = lambda p, e: F.struct(F.concat(p["digits"], e["digits"]).alias("digits"), F.array(p["i"], e["i"]).alias("who"))
        alone = lambda p: F.filter(few, lambda e: e["i"] != p["i"])
        longest = F.array_max(F.transform(few, lambda e: F.length(e["digits"])))

        def may_lead(e: Column) -> Column:
            """A mobile number may begin so, or the whole may be long enough for another."""
            return e["digits"].rlike("^(?:0|8|1(?:[3-9]|\\z))") | (F.length(e["digits"]) + longest * 2 >= 16)

        pairs = F.flatten(F.transform(F.filter(few, may_lead), lambda p: F.transform(alone(p), lambda e: longer(p, e))))

        def named(two: Column) -> Column:
            pair = put_together(F.transform(two, lambda p: p["digits"]))
            three = F.flatten(F.transform(two, lambda p: F.transform(others(p), lambda e: F.concat(p["digits"], e["digits"]))))
            return F.coalesce(pair, put_together(three)) if triples else pair

        return let(pairs, named)

    listed = F.flatten(F.transform(fragments, lambda readings, i: F.transform(readings, lambda d: F.struct(i.alias("i"), d.alias("digits")))))
    least = let(listed, lambda few: F.when(F.size(few).between(2, FEW), one_by_one(few)).when(F.size(few) > FEW, let(entries, joined)))
    return F.when(F.size(fragments) >= 2, least)
