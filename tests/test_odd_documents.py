"""Queries over documents with odd texts and languages, against their SQL."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from callwarden.functions import trigrams
from callwarden.operators import bayes
from callwarden.queries.registry import registered

ODD = [
    None, "", " ", "\n", "A.", "É", "Ê è. ó", "中文", "ab cd", "$", "_9$ x", "no\nnew\tlines", "zero​width", "pаypal", "tag\U000e0041",
    'token = "' + "Ab1" * 14 + '"', 'token = "' + "d48fd8e940" * 4 + '"', "b64:AAAABBBBCCCC", "%41" * 8, "İstanbul Kelvin K",
]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """``documents`` whose language zh and missing language have no trigram of their own, or few."""
    rows = [(i, text, "en" if i % 2 else "fr") for i, text in enumerate(ODD)]
    rows += [(100 + i, text, lang) for i, (text, lang) in enumerate([("中文", "zh"), (None, "zh"), ("", None), ("an plain text", None)])]
    home = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{home}/documents.parquet")
    return str(home)


@pytest.mark.parametrize("name", ["guard_documents", "bayes_languages"])
def test_odd_documents_match_the_sql(spark, home, name):
    query, sql = registered()[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{home}/documents.parquet/*.parquet'")
    df = query(spark, home)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in df.orderBy(df.columns[0]).collect()] == want


def test_scores_of_long_texts_add_up_exactly():
    """The order in which a text's weights are added makes no difference to its score."""
    rng = np.random.default_rng(5)
    logp = -rng.uniform(2, 14, (2, trigrams.CODES))
    model = bayes.BayesModel(("a", "b"), np.array([-0.5, -1.0]), logp)
    words = ["".join(rng.choice(list("abcdefgh0_"), 7)) for _ in range(9000)]
    texts = pa.array([" ".join(words), "", "ab"])
    codes = [[], [], []]
    for rows, found in trigrams.positions(texts):
        for row, code in zip(rows.tolist(), found.tolist()):
            codes[row].append(code)
    want = [[math.fsum([model.prior[k], *logp[k][codes[row]]]) for k in range(2)] for row in range(3)]
    assert model.scores(texts) == pytest.approx(np.array(want), rel=3e-16, abs=0)
