"""Ranked lexical search against brute force and its SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest

from stemma.llm import lexical, queries
from tests.llm.conftest import ODD, SCHEMA, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    held = [(i, Counter(t)) for i, text in docs if i is not None and (t := terms(text))]
    count, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    least = {}
    for i, text in items:
        if i is not None and text is not None:
            least[i] = min(least.get(i, text), text)
    out = []
    for item, text in least.items():
        own = set(terms(text))
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


DOCS = [*[(r[0], r[1]) for r in ODD], *[(100 + i, prose(30 + i % 50, i % 60)) for i in range(300)], (900, "ÀÉ x-RAY İstanbul 漢字 a\x00b\x7fc"), (901, "zz " * 500), (902, "zz")]
ITEMS = [(i, prose(12, i)) for i in range(25)] + [(None, "ba"), (40, None), (41, ""), (42, "?!"), (43, "none-of-these qqqq"), (44, "Àé X ray İSTANBUL 漢字 b"), (45, "zz ZZ"), (46, "ba"), (46, "ba"), (46, "xe")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lexical"))
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in DOCS], SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("item_id", "text", "0 AS score", "'x' AS terms").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_op12_against_brute_force(spark, folder):
    want = ranked(DOCS, ITEMS)
    assert len(want) > 200 and rows(queries.op12_ranked_search(spark, folder)) == want


def test_small_shards_and_slices_change_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 700)
    monkeypatch.setattr(lexical, "SLICE_BYTES", 300)
    assert rows(queries.op12_ranked_search(spark, folder)) == ranked(DOCS, ITEMS)


def test_op12_against_its_sql(spark, folder):
    for at in (folder, "/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet{'/*.parquet' if at == folder else ''}')")
        want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.oracle_sql()['op12_ranked_search']})").fetchall()
        assert rows(queries.op12_ranked_search(spark, at)) == sorted(want) and want


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    shards = lexical.index(no_docs)
    assert shards.count() == 0 and lexical.search(shards, none, 0).count() == 0
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(shards, some, 0).count() == 0
    one = spark.createDataFrame([(5, "a", 1)], "doc_id long, text string, key int")
    assert [tuple(r) for r in lexical.search(lexical.index(one), some, 1).collect()] == [(1, 1, 5, math.floor(1000 * math.log(4 / 3)) * (10**9 // 1800))]
    assert lexical.search(lexical.index(one), none, 1).count() == 0


def test_postings_are_compressed_sparse_rows(spark):
    docs = spark.createDataFrame([(7, "b a b"), (8, None), (9, "c b")], "doc_id long, text string").coalesce(1)
    assert lexical.statistics(docs) == (2, 5)
    r = lexical.index(docs).first()
    assert (r["documents"], r["terms"], r["starts"], r["places"]) == ([7, 8, 9], ["a", "b", "c"], [0, 1, 3, 4], [0, 0, 2, 2])
    norm = {0: 10 + 90 * 3 * 2 // 5, 2: 10 + 90 * 2 * 2 // 5}
    assert r["impacts"] == [10**9 * tf // (1000 * tf + 8 * norm[d]) for d, tf in ((0, 1), (0, 2), (2, 1), (2, 1))]
