import re

import pytest
from pyspark.sql import functions as F

from siftgraph.functions import text as tx
from siftgraph.functions.fixed import KEYWORD_PATTERNS
from siftgraph.operators import gates

RAW = "id string, title string, authors string, published string, summary string, link string, categories string"


def flags(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


TEXTS = [
    ("AI safety", None),
    ("ai SAFETY", "x"),
    (None, "about ai alignment here"),
    ("the model", "safety evaluation"),
    ("frontier models", "and safety"),  # split by the line feed between title and summary
    ("frontier models and safety", ""),
    ("frontier models\rand safety", ""),  # only a line feed ends a line
    ("we use guardrails", ""),
    ("a guardrail here", ""),
    ("assurance case", ""),
    ("Model card", "nothing"),
    ("ai ſafety", ""),  # long s folds to s
    ("corrigibility", ""),
    ("incorrigible", ""),
    ("", ""),
    (None, None),
    ("governance", "of systems"),
    ("governance of systems", ""),
    ("éAI safety", ""),  # no boundary between two letters
    ("ISO/IEC  42001", ""),
]


def test_keyword_gate_matches_python(spark):
    pattern = re.compile("|".join(KEYWORD_PATTERNS), re.IGNORECASE)
    expected = [bool(pattern.search((a or "") + "\n" + (b or ""))) for a, b in TEXTS]
    assert flags(spark, TEXTS, gates.keyword_hit(F.col("a"), F.col("b"))) == expected
    assert expected[4] is False and expected[5] is True and expected[6] is True
    assert expected[7] is False and expected[9] is True and expected[11] is True


def test_one_pattern_keeps_alternatives():
    one = gates.one_pattern([r"\ba(x|y)\b|\bb[|]c", r"q|\bz\|w"])
    assert one == r"\b(?:a(x|y)\b|b[|]c|z\|w)|q"
    assert len(gates._alternatives("a|b")) == 2 and gates._alternatives("") == [""]


def test_category_and_domain(spark):
    rows = [("econ.GN", ""), ("cs.CY  cs.LG", ""), ("cs.LG", ""), (None, ""), ("", ""),
            ("q-fin.ST", ""), ("econ.EM stat.ML", ""), (" cs.CYX", "")]
    assert flags(spark, rows, gates.category_hit(F.col("a"))) == [
        True, True, False, False, False, False, True, False,
    ]
    assert flags(spark, rows, tx.domain_tag(F.col("a"))) == [
        "gov", "tech", "tech", "unknown", "unknown", "unknown", "both", "tech",
    ]


def test_stage1(spark):
    rows = [
        ("1", "AI safety", "a", "d", "s", "l", "cs.LG"),
        ("2", "A system", "a", "d", "s", "l", "cs.CY"),
        ("3", "A system", "a", "d", "s", "l", "cs.LG"),
        ("4", "Nothing", "a", "d", "s", "l", "econ.GN"),
        ("5", None, "a", "d", None, "l", None),
    ]
    raw = spark.createDataFrame(rows, RAW)
    found = {r["id"]: r["ai_regex_hit"] for r in gates.stage1(raw).collect()}
    assert found == {"1": 1, "2": 0}
    everything = {r["id"]: r["ai_regex_hit"] for r in gates.stage1(raw, keep_all=True).collect()}
    assert everything == {"1": 1, "2": 0, "3": 0, "4": 0, "5": 0}


def test_generic_phrase(spark):
    rows = [(p, "") for p in ["models", "language models", "ai models", "", "?!", "papers", "bus", None]]
    assert flags(spark, rows, tx.is_generic_phrase(F.col("a"))) == [
        True, True, False, True, True, True, False, True,
    ]


@pytest.mark.parametrize(
    "title, short",
    [("A: b", "A"), ("A: b\nC: d", "A: b\nC"), ("plain ", "plain"), ("A: b\n", "A"), (None, "")],
)
def test_strip_subtitle(spark, title, short):
    assert flags(spark, [(title, "")], tx.strip_subtitle(F.col("a"))) == [short]


def test_ellipsize_and_strip(spark):
    rows = [("  abcdef\n", ""), ("abc", ""), (None, ""), ("  x\x1c", "")]
    assert flags(spark, rows, tx.ellipsize(F.col("a"), 3)) == ["abc…", "abc", None, "x"]


def test_term_count(spark):
    rows = [("aaaaa", "aa"), ("abc", "z"), ("", "a"), ("a.b.c", ".")]
    assert flags(spark, rows, tx.term_count(F.col("a"), F.col("b"))) == [2, 0, 0, 2]


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("HTTPS://User@Ex.Org:443/P?q=1#f", "https://User@ex.org/P"),
        ("http://ex.org", "http://ex.org/"),
        ("http://ex.org?x", "http://ex.org/"),
        ("http://ex.org:8080/a#b", "http://ex.org:8080/a"),
        ("no url?x", "no url?x"),
        ("", ""),
        ("mailto:a@b?subject=x", "mailto:a@b"),
        ("http://?x", "http://?x"),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert flags(spark, [(url, "")], tx.canonical_url(F.col("a"))) == [canonical]
