"""Names, labels and tops over calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.operators import identify, metrics
from callwarden.queries import oracle as D
from callwarden.queries import report_queries
from callwarden.queries.base import calls, table, truth, verdicts


def token_parts(spark, sf):
    """Class and method names that identify a type by themselves, for every API name seen."""
    names = calls(spark, sf).groupBy("token").agg(F.count("*").alias("n"))
    return names.select(
        "token", "n", identify.class_token(F.col("token")).alias("class_name"), identify.method_token(F.col("token")).alias("method_name")
    )


TOKEN_PARTS = D.with_(D.CALLS) + """,
t AS (SELECT token, count(*) AS n FROM calls GROUP BY 1),
p AS (SELECT token, n,
  lower(CASE WHEN contains(token, ' ') THEN split_part(split_part(token, ' ', 1), '.', -1)
    WHEN contains(token, '.') THEN split_part(regexp_replace(token, '\\.[^.]*$', ''), '.', -1) ELSE token END) AS c,
  CASE WHEN contains(token, ' ') THEN substr(token, strpos(token, ' ') + 1) ELSE split_part(token, '.', -1) END AS m FROM t)
SELECT token, n, CASE WHEN length(c) >= 5 AND c NOT IN """ + D.members(report_queries.vocab.GENERIC_CLASSES) + """ THEN c END AS class_name,
  CASE WHEN length(m) >= 8 AND (length(m) >= 10 OR length(regexp_replace(m, '[^A-Z]', '', 'g')) >= 2) THEN lower(m) END AS method_name FROM p"""


def truth_paths(spark, sf):
    """What happened to every call against its truth, those without a truth among them."""
    joined = metrics.truth_join(verdicts(spark, sf).select("id", "violation", "needs_review"), truth(spark, sf))
    return metrics.with_outcome(joined).groupBy("path").agg(F.count("*").alias("n"))


TRUTH_PATHS = report_queries.PATHS + """
SELECT path, count(*) AS n FROM paths GROUP BY 1
UNION ALL SELECT 'unlabelled', count(*) FROM truth WHERE true_violation IS NULL HAVING count(*) > 0"""


def top_events(spark, sf):
    """Most frequent kinds of events."""
    return metrics.top_k(table(spark, sf, "events"), "event_type", 3)


TOP_EVENTS = "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3"

QUERIES = {
    "token_parts": (token_parts, TOKEN_PARTS),
    "truth_paths": (truth_paths, TRUTH_PATHS),
    "top_events": (top_events, TOP_EVENTS),
}
