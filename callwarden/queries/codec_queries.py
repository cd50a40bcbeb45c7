"""Decoding, numerals and split numbers as set jobs, against answers computed from the plain values."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.functions import automaton, sqlx
from callwarden.functions import decode as D
from callwarden.operators import evidence
from callwarden.operators.staging import seal
from callwarden.queries.base import spread, table


def _phone():
    return F.concat(F.lit("1"), (F.col("event_id") % 7 + 3).cast("string"), F.lpad((F.col("event_id") * 7919 % 1000000000).cast("string"), 9, "0"))


def decoded_values(spark, sf):
    """Numbers under one or two codecs, found again with the codecs' names and the depth."""
    phone = _phone()
    code = lambda c: F.base64(c.cast("binary"))
    kind = F.col("event_id") % 6
    value = (
        F.when(kind == 0, code(phone)).when(kind == 1, F.hex(phone.cast("binary"))).when(kind == 2, F.regexp_replace(phone, "([0-9])", "%3$1"))
        .when(kind == 3, F.reverse(phone)).when(kind == 4, code(code(phone))).otherwise(F.hex(code(phone).cast("binary")))
    )
    values = spread(table(spark, sf, "events")).select(value.alias("value")).distinct()
    found = evidence.decode_frontier(values, rounds=2)
    return found.where(F.col("product").rlike("^1[3-9][0-9]{9}$")).select("value", "product", "codec", "depth")


#: Every value is decoded by DuckDB's own functions, once and twice.
DECODED_VALUES = """
WITH p AS (SELECT event_id, '1' || (event_id % 7 + 3) || lpad(CAST(event_id * 7919 % 1000000000 AS VARCHAR), 9, '0') AS phone FROM events),
v AS (SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN base64(encode(phone)) WHEN 1 THEN hex(encode(phone)) WHEN 2 THEN regexp_replace(phone, '([0-9])', '%3\\1', 'g')
    WHEN 3 THEN reverse(phone) WHEN 4 THEN base64(encode(base64(encode(phone)))) ELSE hex(encode(base64(encode(phone)))) END AS value FROM p),
once AS (SELECT value, t AS product, c AS codec, 1 AS depth FROM (
  SELECT value, unnest([CASE WHEN regexp_matches(value, '^[A-Za-z0-9+/]+={0,2}$') AND length(value) % 4 = 0 AND length(value) >= 8 THEN try(decode(from_base64(value))) END,
    CASE WHEN regexp_matches(value, '^([0-9A-Fa-f]{2})+$') THEN try(decode(unhex(value))) END, CASE WHEN contains(value, '%') THEN url_decode(value) END, reverse(value)]) AS t,
    unnest(['base64', 'hex', 'url', 'reverse']) AS c FROM v) WHERE t IS NOT NULL AND t <> value),
twice AS (SELECT value, t AS product, c AS codec, 2 AS depth FROM (
  SELECT value, unnest([CASE WHEN regexp_matches(product, '^[A-Za-z0-9+/]+={0,2}$') AND length(product) % 4 = 0 AND length(product) >= 8 THEN try(decode(from_base64(product))) END,
    CASE WHEN regexp_matches(product, '^([0-9A-Fa-f]{2})+$') THEN try(decode(unhex(product))) END, reverse(product)]) AS t, unnest(['base64', 'hex', 'reverse']) AS c FROM once) WHERE t IS NOT NULL),
hits AS (SELECT * FROM once UNION ALL SELECT * FROM twice)
SELECT value, product, min(codec) AS codec, depth FROM hits h WHERE product <> value AND regexp_matches(product, '^1[3-9][0-9]{9}$')
  AND NOT EXISTS (SELECT 1 FROM hits e WHERE e.value = h.value AND e.product = h.product AND e.depth < h.depth) GROUP BY value, product, depth"""


def cjk_numerals(spark, sf):
    """Numbers spelled with CJK digits and units, in plain and in financial characters, folded back."""
    number = (F.col("event_id") * 7919 % 99999989 + 11).alias("number")
    df = spread(table(spark, sf, "events")).select("event_id", number)

    def group(n, digits: str, units: str):
        """Up to four digits, each with its unit; zeros are left out."""
        parts = []
        for place, unit in zip((1000, 100, 10, 1), units, strict=True):
            digit = F.floor(n / place) % 10
            spelled = F.substr(F.lit(digits), (digit + 1).cast("int"), F.lit(1))
            parts.append(F.when(digit > 0, F.concat(spelled, F.lit(unit.strip()))).otherwise(""))
        return F.concat(*parts)

    def spelled(digits: str, units: str):
        high, low = F.floor(F.col("number") / 10000), F.col("number") % 10000
        return F.concat(F.when(high > 0, F.concat(group(high, digits, units), F.lit("万"))).otherwise(""), group(low, digits, units))

    plain, formal = spelled("零一二三四五六七八九", "千百十 "), spelled("零壹贰叁肆伍陆柒捌玖", "仟佰拾 ")
    both = df.select("event_id", F.when(F.col("event_id") % 2 == 0, plain).otherwise(formal).alias("spelled"))
    text = sqlx.concat("tel ", sqlx.col("spelled"), "; 一三八")
    return both.select(F.col("event_id").alias("id"), D.fold_cjk_numerals(text).column().alias("folded"))


CJK_NUMERALS = "SELECT event_id AS id, 'tel ' || (event_id * 7919 % 99999989 + 11) || '; 一三八' AS folded FROM events"


def joined_numbers(spark, sf):
    """Shapes of numbers cut into two or three of five fragments."""
    phone, n = _phone(), F.col("event_id")
    piece = lambda a, size: F.substr(phone, F.lit(a), F.lit(size))
    text = lambda value, width: F.lpad((value % 10**width).cast("string"), width, "0")
    parts = (
        F.when(n % 4 == 0, F.array(piece(8, 4), text(n * 31, 2), piece(1, 3), text(n * 17, 3), piece(4, 4)))
        .when(n % 4 == 1, F.array(piece(4, 8), text(n * 13, 5), piece(1, 3)))
        .when(n % 4 == 2, F.array(piece(1, 3), piece(4, 4), text(n * 29, 6)))
        .otherwise(F.array(text(n * 41, 8), text(n * 43, 7), text(n * 47, 1)))
    )
    df = seal(spread(table(spark, sf, "events")).select(n.alias("id"), parts.alias("parts")), "parts")
    fragments = sqlx.transform(sqlx.col("parts"), lambda p: sqlx.array(p))
    return df.select("id", automaton.joined_shape(fragments).column().alias("shape"))


#: All orders of two and of three fragments.
JOINED_NUMBERS = """
WITH p AS (SELECT event_id AS n, '1' || (event_id % 7 + 3) || lpad(CAST(event_id * 7919 % 1000000000 AS VARCHAR), 9, '0') AS t FROM events),
f AS (SELECT n AS id, CASE n % 4
  WHEN 0 THEN [substr(t, 8, 4), lpad(CAST(n * 31 % 100 AS VARCHAR), 2, '0'), substr(t, 1, 3), lpad(CAST(n * 17 % 1000 AS VARCHAR), 3, '0'), substr(t, 4, 4)]
  WHEN 1 THEN [substr(t, 4, 8), lpad(CAST(n * 13 % 100000 AS VARCHAR), 5, '0'), substr(t, 1, 3)]
  WHEN 2 THEN [substr(t, 1, 3), substr(t, 4, 4), lpad(CAST(n * 29 % 1000000 AS VARCHAR), 6, '0')]
  ELSE [lpad(CAST(n * 41 % 100000000 AS VARCHAR), 8, '0'), lpad(CAST(n * 43 % 10000000 AS VARCHAR), 7, '0'), lpad(CAST(n * 47 % 10 AS VARCHAR), 1, '0')] END AS parts FROM p),
x AS (SELECT id, unnest(parts) AS d, generate_subscripts(parts, 1) AS i FROM f),
two AS (SELECT a.id, a.i, b.i AS j, a.d || b.d AS d FROM x a JOIN x b ON a.id = b.id AND a.i <> b.i),
three AS (SELECT t.id, t.d || c.d AS d FROM two t JOIN x c ON t.id = c.id AND c.i <> t.i AND c.i <> t.j),
named AS (SELECT id, r, CASE WHEN regexp_matches(d, '^(0086|00|86|0)?0*1[3-9][0-9]{9}$') THEN 1 WHEN length(d) = 18 THEN 2 WHEN length(d) BETWEEN 16 AND 19 THEN 3 END AS s
  FROM (SELECT id, d, 2 AS r FROM two UNION ALL SELECT id, d, 3 FROM three)),
best AS (SELECT id, min(r * 10 + s) % 10 AS s FROM named WHERE s IS NOT NULL GROUP BY 1)
SELECT f.id, CASE s WHEN 1 THEN 'mobile' WHEN 2 THEN 'idcard' WHEN 3 THEN 'bankcard' END AS shape FROM f LEFT JOIN best USING (id)"""

QUERIES = {
    "decoded_values": (decoded_values, DECODED_VALUES),
    "cjk_numerals": (cjk_numerals, CJK_NUMERALS),
    "joined_numbers": (joined_numbers, JOINED_NUMBERS),
}
