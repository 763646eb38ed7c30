"""Periodic runs against a brute-force search, at every lag, with and without dealing lags out."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from stemma.llm import periods, queries
from tests.llm.conftest import ODD, SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, exponent=4, least=6):
    """Every maximal stretch of a period, word by word; of one stretch the least period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, k) for (s, k), q in found.items())


def collapsed_of(words, runs):
    gone = {i for s, q, k in runs for i in range(s + q, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_of(words)
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{k},{q}\n" for s, q, k in runs)), sha(collapsed_of(words, runs)))


def texts_with_runs(count, seed):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
        parts = [rng.choice("abc") for _ in range(rng.randint(0, 25))] + unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))] + [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        out.append(rng.choice([" ", "\t", " \n", "\x0b"]).join(parts) if i % 9 else "")
    return out


def test_scanned_against_brute_force():
    for exponent, least in ((4, 6), (2, 2), (3, 9)):
        texts = [t.split() for t in texts_with_runs(150, exponent)]
        ids = np.array([ord(w) for t in texts for w in t], np.int32)
        got = periods.scanned(ids, np.array([len(t) for t in texts]), exponent, least)
        for d, words in enumerate(texts):
            own = got[got["doc"] == d][["start", "period", "length"]].to_numpy().tolist()
            assert own == [list(r) for r in runs_of(words, exponent, least)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("periods"))
    long = prose(9_000, 3)
    rows = [*ODD, *[(100 + i, t, "en", "s", None) for i, t in enumerate(texts_with_runs(400, 1))], (700, long, "en", "s", None), (701, long, "en", "t", None)]
    rows += [(702, " ".join([prose(2_500, 4)] * 5), "en", "s", None), (703, "ha " * 30_000, "en", "s", None), (704, "a b\x85c\x1cd\x00e " * 8, "en", "s", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


def row(r):
    return tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def test_op11_against_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    short = [r for r in rows if len(r["text"] or "") < 60_000]
    got = [row(r) for r in queries.op11_periodic_runs(spark, folder).collect()]
    assert len(got) == len(rows)
    ids = {r["doc_id"] for r in short}
    assert sorted(map(str, (g for g in got if g[0] in ids))) == sorted(str(expected(r["doc_id"], r["text"])) for r in short)
    assert sum(g[1] > 0 for g in got) > 100
    # dealt out by lag ranges
    by = {g[0]: g for g in got}
    assert by[700][1:] == by[701][1:] or {zlib.crc32(b"700") % 10, zlib.crc32(b"701") % 10} & {0}
    assert zlib.crc32(b"702") % 10 and by[702][1:6] == (1, 0, 12_500, 2_500, 5_000)
    assert by[702][7] == hashlib.sha256(prose(2_500, 4).encode()).hexdigest()
    assert by[703][1:6] == (1, 0, 30_000, 1, 30_000_000) and by[703][7] == hashlib.sha256(b"ha").hexdigest()


def test_dealing_lags_out_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts_with_runs(60, 5), None, ""])], "doc_id long, text string, runs string")
    near = sorted(map(str, periods.periodic_runs(docs).collect()))
    monkeypatch.setattr(periods, "LONG", 20)
    monkeypatch.setattr(periods, "LAGS", 3)
    assert sorted(map(str, periods.periodic_runs(docs).collect())) == near
    assert periods.periodic_runs(docs).columns == ["doc_id", "text", "runs", "collapsed"]


def test_empty_table(spark, no_docs):
    assert periods.periodic_runs(no_docs).count() == 0


def test_op11_against_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got = queries.op11_periodic_runs(spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op11_periodic_runs']})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
