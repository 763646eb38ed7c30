import math

import pytest
from pyspark.sql import functions as F

from stemma.functions import names, scoring


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "cc,cog,depth,hd,mi,expected",
    [(1, 0, 0, 2, 90, 1.0), (2, 1, 0, 3, 85, 1.0), (20, 25, 8, 30, 0, 0.02), (30, 40, 10, 50, 0, 0.0), (87, 0, 0, 0, 100, 0.55)],
)
def test_health_score(spark, cc, cog, depth, hd, mi, expected):
    got = one(spark, scoring.health_score(*[F.lit(x) for x in (cc, cog, depth, hd, mi)]))
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("cc,cog,depth,hd,mi", [(1, 7, 7, 26.6, 56.0), (1, 6, 7, 26.6, 56.0)])
def test_a_score_at_the_bound_of_a_band_is_that_of_the_sql(spark, cc, cog, depth, hd, mi):
    """0.8 but for rounding: DuckDB sums what counts cost in decimals, the rest in doubles from left to right."""
    score = scoring.health_score(*[F.lit(x) for x in (cc, cog, depth, hd, mi)])
    assert one(spark, score) == (1000 - 160) / 1000 - (hd - 15) * 0.005 + mi / 100 * 0.3 - 0.15
    assert one(spark, scoring.score_band(score)) == "stressed"


def test_defaults_and_instability(spark):
    none = F.lit(None).cast("double")
    assert one(spark, scoring.health_score(none, none, none, none, none)) == 1.0
    args = [F.lit(x) for x in (20, 0, 0, 0, 100)]
    assert one(spark, scoring.health_score(*args, F.lit(0.9), F.lit(6))) == pytest.approx(one(spark, scoring.health_score(*args)) - 0.15)


def test_ids(spark):
    assert one(spark, scoring.node_id(F.lit("module"), F.lit("cli"))) == "2f61ff7cfb15fbd5"


@pytest.mark.parametrize(
    "kind,name,callers,itself,score,expected",
    [
        ("function", "_a", 0, False, 1.0, "necrotic"),
        ("function", "_a", 1, False, 1.0, "healthy"),
        ("function", "__a__", 0, False, 0.7, "stressed"),
        ("class", "_a", 0, False, 0.3, "inflamed"),
        ("method", "a", 0, True, 1.0, "inflamed"),
        ("function", "a", None, None, 0.1, "cancerous"),
    ],
)
def test_status(spark, kind, name, callers, itself, score, expected):
    cast = lambda v, t: F.lit(v).cast(t)
    assert one(spark, scoring.health_status(F.lit(kind), F.lit(name), F.lit(f"m.{name}"), cast(callers, "long"), cast(itself, "boolean"), F.lit(score))) == expected


def test_notes(spark):
    assert one(spark, scoring.health_notes(F.lit("stressed"), F.lit(False), F.lit(0.654))) == ["Moderate complexity (score: 0.65)"]
    assert one(spark, scoring.health_notes(F.lit("healthy"), F.lit(None).cast("boolean"), F.lit(0.9))) == []


def test_maintainability_and_halstead(spark):
    assert one(spark, scoring.maintainability(F.lit(0.0), F.lit(1), F.lit(0))) == 100.0
    expected = round((171 - 5.2 * math.log(50) - 0.23 * 3 - 16.2 * math.log(10)) * 100 / 171, 2)
    assert one(spark, scoring.maintainability(F.lit(50.0), F.lit(3), F.lit(10))) == pytest.approx(expected)
    h = scoring.halstead(F.lit(4), F.lit(3), F.lit(10), F.lit(6))
    assert one(spark, h["volume"]) == pytest.approx(16 * math.log2(7)) and one(spark, h["difficulty"]) == pytest.approx(4)
    assert one(spark, scoring.halstead(F.lit(4), F.lit(0), F.lit(10), F.lit(0))["volume"]) == 0.0


@pytest.mark.parametrize("name,words", [("parseAST", ["parse", "AST"]), ("XMLParser", ["XML", "Parser"]), ("snake_case x", ["snake", "case", "x"]), ("", [])])
def test_words(spark, name, words):
    assert one(spark, names.words_of(F.lit(name))) == words


def test_telling_words_and_titles(spark):
    assert one(spark, names.telling_words(F.lit("getUserAccount_of_x"))) == ["user", "account"]
    assert one(spark, names.titled(names.telling_words(F.lit("a_b")))) is None
    assert one(spark, names.titled(F.array(*[F.lit(w) for w in "parse tree walk far".split()]))) == "Parse Tree Walk"


@pytest.mark.parametrize("text,lines", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["a", "", "b"]), ("a\r\nb\rc\x0bd", ["a", "b", "c", "d"])])
def test_lines(spark, text, lines):
    assert one(spark, names.lines_of(F.lit(text))) == lines


def test_paths(spark):
    assert one(spark, names.prefixes(F.lit("a/b/c.py"))) == ["a", "a/b", "a/b/c.py"]
    assert [one(spark, names.language_of(F.lit(p))) for p in ("a.py", "x/B.TSX", "a.csv", "noext", "a.hpp")] == ["python", "tsx", None, None, "cpp"]
    assert one(spark, names.stem(F.lit("x/y/__init__.py"))) == "__init__"
    arrays = F.array(*[F.array(*[F.lit(x) for x in p]) for p in (["a", "b", "c"], ["a", "b"], ["a", "b", "d"])])
    assert one(spark, names.common_prefix(arrays)) == ["a", "b"]
    assert one(spark, names.shortened(F.lit("x" * 120))) == "x" * 100 + "..."
