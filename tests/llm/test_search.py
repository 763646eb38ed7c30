"""Top-k, vectors, SimHash, sharding against brute force."""

import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stemma.llm import components, neighbours, queries, sharding, simhash, tiles, topk


def groups_of(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == {k: v for k, v in groups_of(real, {x for p in real for x in p}).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(120)] + [(500 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(40)]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan"), 1.0, 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (905, [1.0, 2.0]), (500, [1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, vector array<double>").withColumn("rank", F.lit("x"))
    got = topk.top_k(table, table.filter("vec_id % 50 = 0"), 5).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i, _ in rows if i % 50 == 0}
    for q, v in rows:
        if q % 50 == 0:
            best = sorted((-int(np.dot(v, w)), i) for i, w in [*rows, odd[-1]] if i != q)[:5]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_of_few_rows(spark):
    two = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, vector array<double>")
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(two, two, 5).collect()) == [(0, 50, 2), (50, 0, 2)]
    assert topk.top_k(two.limit(0), two.limit(0)).count() == 0


def test_integers_round_down(spark):
    v = spark.createDataFrame([([0.5, -0.001, 0.0],)], "v array<float>").select(topk.integers(F.col("v")).alias("v")).first()["v"]
    assert v == [128.0, -1.0, 0.0]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(16)
        for _ in range(60 if c == 0 else rng.integers(1, 4)):
            rows.append((len(rows), [float(x) for x in centre + rng.standard_normal(16) * 0.03], int(c % 3)))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(3)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, rows[0][1], None), (n + 3, [None] * 16, 0), (n + 4, [], 1), (n + 5, [float("nan")] * 16, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("c", F.lit(1))
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(table).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    labels = np.array([x for _, _, x in rows])
    close = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(close, False)
    assert close.sum(1).max() > neighbours.NEIGHBOURS  # some lists must be enlarged
    truth = groups_of([(a, b) for a, b in zip(*np.nonzero(close), strict=True)], range(n))
    assert len(got) == n + len(odd)
    found = sum(got[i]["n_links"] for i in range(n))
    assert found <= close.sum() and found >= 0.95 * close.sum()
    assert np.mean([got[i]["component_id"] == truth[i] for i in range(n)]) > 0.95
    for i, _, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert neighbours.near_duplicates(table.limit(0)).count() == 0


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_docs):
    for r in odd_docs.collect():
        assert simhash.fingerprint(r["text"] or "") == slow_fingerprint(r["text"] or "")
    assert simhash.fingerprint("Ab a b. " * 700) == slow_fingerprint("Ab a b. " * 700)


def test_simhash_query_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    odd_docs.withColumn("fp", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_simhash_near_dedup(spark, str(tmp_path)).collect()
    rows = odd_docs.collect()
    prints = [slow_fingerprint(r["text"] or "") for r in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(r["doc_id"]), format(p, "016x")) for r, p in zip(rows, prints, strict=True))
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == by[None] == 1 and by[8] == by[7] == 7
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_within_two_bits_light_and_heavy(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(rng.randint(0, 3)):
            values.add(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    crowd = rng.getrandbits(64)  # many that agree on whole parts
    for _ in range(150):
        values.add(crowd ^ rng.getrandbits(6) ^ rng.getrandbits(3) << 60)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), heavy=16).collect()]
    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    truth = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert groups_of(links, signed) == groups_of(truth, signed)


def test_allocations_are_optimal():
    rng = np.random.default_rng(2)
    cost = rng.random((50, 3, 3))
    best = simhash.allocations(cost, 0)
    for row, pick in zip(cost, best, strict=True):
        options = [(sum(row[i, t[i] + 1] for i in range(3)), t) for t in ((x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)) if sum(t) == 0]
        assert abs(sum(row[i, pick[i] + 1] for i in range(3)) - min(options)[0]) < 1e-12


def test_near_copies_are_found(spark):
    from tests.llm.conftest import prose

    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = prose(200, 1000 + k).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 1, 1, 60 if k == 0 else 2])):
            edited = list(words)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = "zz" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(edited).upper() if rng.random() < 0.2 else " ".join(edited)))
    rows += [(None, rows[0][1]), (3000, None), (3001, ""), (3002, None), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("digest", F.lit("d"))
    kept = simhash.without_near_copies(table)
    assert kept.columns == table.columns
    sets = [simhash.shingle_set(t or "") for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8]
    truth = groups_of(pairs, range(len(rows)))
    want = set()
    for g in set(truth.values()):
        want.add(min((r[0] for i, r in enumerate(rows) if truth[i] == g and r[0] is not None), default=None))
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert simhash.without_near_copies(table.limit(0)).count() == 0


def test_shards_are_balanced_contiguous_and_whole(spark, odd_docs, no_docs, tmp_path):
    from tests.llm.conftest import prose

    rows = [(i, prose(5 + i % 40, i)) for i in range(600)] + [(600 + i, "copy " * 30) for i in range(60)] + [(700 + i, "many " * 8) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.filter("doc_id <> 6 OR doc_id IS NULL").select("doc_id", "text")).withColumn("slot", F.lit(0))
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    size, shards = {}, {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + len((r["text"] or "").encode()) + 1
        shards.setdefault(r["shard"], []).append(r["slot"])
    for own in shards.values():
        assert sorted(own) == list(range(len(own)))
    mean = sum(size.values()) / 8
    assert set(size) == set(range(8)) and max(size.values()) < 1.15 * mean and min(size.values()) > 0.85 * mean
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in by_text.items() if t != "many " * 8)
    sharding.write_shards(sharding.shard(docs), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)
    assert sharding.shard(no_docs).count() == 0
    only = spark.createDataFrame([(1, "same")] * 9, "doc_id long, text string")
    assert sorted(r["slot"] for r in sharding.shard(only).collect() if r["shard"] == sharding.shard(only).first()["shard"])[0] == 0


def test_query_of_shards(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_sharding(spark, str(tmp_path)).collect()
    expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == expected
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_near_copies_at_the_threshold_meet_in_a_band(spark):
    from tests.llm.conftest import prose

    rng = random.Random(12)
    rows, pairs = [], 0
    for k in range(400):
        words = prose(300, 50_000 + k).split()
        other = list(words)
        if k % 3 == 0:  # appended text
            other += prose(rng.randint(60, 74), 60_000 + k).split()
        elif k % 3 == 1:  # a replaced block
            other[100 : 100 + 27] = prose(27, 60_000 + k).split()
        else:
            for i in rng.sample(range(300), 6):
                other[i] = f"zz{rng.randrange(10**6)}"
        pair = " ".join(words), " ".join(other)
        if 0.8 <= simhash.jaccard(*map(simhash.shingle_set, pair)) < 0.87:
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
            pairs += 1
    assert pairs > 200
    kept = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 2 * pairs - kept >= 0.98 * pairs


def test_near_copies_in_a_family_below_the_threshold(spark, monkeypatch):
    from tests.llm.conftest import prose

    monkeypatch.setattr(tiles, "TILE", 40)
    rng, template = random.Random(13), prose(200, 70_000).split()
    rows = []
    for k in range(150):
        words = list(template)
        words[60:80] = prose(20, 71_000 + k).split()  # the family is alike below the threshold
        copy = list(words)
        for i in rng.sample(range(90, 190, 6), 4):
            copy[i] = f"zz{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    sets = [simhash.shingle_set(t) for _, t in rows]
    assert max(simhash.jaccard(sets[0], s) for s in sets[2:]) < 0.8 <= min(simhash.jaccard(sets[2 * k], sets[2 * k + 1]) for k in range(150))
    kept = sorted(r["doc_id"] for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(kept) <= 153 and set(range(0, 300, 2)) <= set(kept)


def test_simhashes_propose_near_copies_where_no_band_meets(spark):
    from tests.llm.conftest import prose

    rng, rows, pairs = random.Random(5), [], set()
    for k in range(60):
        words = prose(400, 90_000 + k).split()
        other = list(words)
        other[rng.randrange(400)] = f"zz{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if bin(simhash.fingerprint(rows[-2][1]) ^ simhash.fingerprint(rows[-1][1])).count("1") <= 2:
            pairs |= {(2 * k, 2 * k), (2 * k + 1, 2 * k)}
    line = "one line that stands in the text many times " * 60  # equal SimHashes, other words
    rows += [(200 + k, line + prose(100, 95_000 + k)) for k in range(2)]
    assert len(pairs) > 40 and simhash.fingerprint(rows[-1][1]) == simhash.fingerprint(rows[-2][1]) and simhash.jaccard(*[simhash.shingle_set(t) for _, t in rows[-2:]]) < 0.8
    docs = spark.createDataFrame(rows, "uid long, text string")
    apart = simhash.written(simhash._prints(docs).withColumn("bands", F.array("uid")))
    assert {(r["uid"], r["component"]) for r in simhash._groups(apart, docs).collect() if r["uid"] < 200} >= pairs
    assert {r["component"] for r in simhash._groups(apart, docs).filter("uid >= 200").collect()} in (set(), {200, 201})


def test_top_k_query_leaves_non_finite_vectors_out(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.25]), (2, [-3.0, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 1.0]), (50, [nan, nan]), (100, [1.0, inf]), (150, [-1.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op7_top_k(spark, str(tmp_path)).collect())
    unit = 256 * 256
    assert got == [(0, 1, 1, 0), (0, 2, 2, -unit), (0, 3, 150, -3 * unit), (150, 1, 2, 2 * unit), (150, 2, 1, -unit // 4), (150, 3, 0, -3 * unit)]


def pockets():
    """Pockets of 24 near-equal vectors of one label, in a chain and apart; links between pockets are at 0.98 to 0.99."""
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(12):
        centre, side = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        for step in range(4):
            middle = np.cos(0.165 * step) * centre + np.sin(0.165 * step) * side
            rows += [middle + rng.standard_normal(32) * 0.002 for _ in range(24)]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    close = unit @ unit.T >= 0.98
    np.fill_diagonal(close, False)
    return unit, close, groups_of(list(zip(*np.nonzero(close), strict=True)), range(len(rows)))


def test_pockets_of_near_equal_vectors_are_joined(spark):
    unit, close, truth = pockets()
    assert len(set(truth.values())) == 12 and close.sum(1).max() == 71
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(unit)], "vec_id long, embedding array<double>, label int")
    got = neighbours.near_duplicates(table).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == truth
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(n) for i, n in enumerate(close.sum(1))}


def test_vectors_are_compared_whole_when_the_audit_fails(spark, monkeypatch):
    unit, close, truth = pockets()
    monkeypatch.setattr(neighbours, "TRIES", 1)
    monkeypatch.setattr(neighbours, "TILE", 50)
    monkeypatch.setattr(neighbours, "audited", lambda *_: 0.0)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(unit[::3])], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(table).collect()}
    want = close[::3, ::3]
    assert {i: r["n_links"] for i, r in got.items()} == {i: int(n) for i, n in enumerate(want.sum(1))}
    assert {i: r["component_id"] for i, r in got.items()} == groups_of(list(zip(*np.nonzero(want), strict=True)), range(len(want)))


def test_top_k_and_near_dedup_queries_against_their_sql(spark, tmp_path):
    """Null, NaN, infinite, zero and empty vectors, repeated ids and rows, null labels: the registered queries on a table of odd rows."""
    import duckdb

    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 6))
    rows = [(i, [float(x) for x in base[i % 12] + rng.standard_normal(6) * rng.choice([0.0, 0.05, 1.0])], f"l{i % 3}" if i % 11 else None) for i in range(240)]
    nan, inf = float("nan"), float("inf")
    odd = [(300, None, "l0"), (350, [nan, 1.0, 1.0, 1.0, 1.0, 1.0], "l0"), (351, [inf] * 6, "l0"), (352, [-inf, 1.0, 1.0, 1.0, 1.0, 1.0], "l1"), (353, [0.0] * 6, "l0"), (354, [], "l0"), (355, [1.0, None, 1.0, 1.0, 1.0, 1.0], "l1"), (400, [9.0] * 6, "l2"), (401, [9.0] * 6, "l2"), (401, [9.0] * 6, "l2"), (7, [8.0] * 6, "l1")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string").withColumn("score", F.lit("x"))
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name, query in (("op7_top_k", queries.op7_top_k), ("op8_embedding_near_dedup", queries.op8_embedding_near_dedup)):
        got = query(spark, str(tmp_path))
        columns = sorted(got.columns)
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected)
        assert len(expected) > 20
