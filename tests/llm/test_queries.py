"""The registered queries against brute force, and odd rows through every operator and stage."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stemma.llm import langid, passages, queries, sharding, token_counts, toxicity
from stemma.llm.shared import written
from tests.llm.conftest import ODD, SCHEMA, prose
from tests.llm.test_text import toxic_rows

#: Columns of an input that are called like an output or like a column an operator uses.
CLASHING = ["uid", "digest", "__digest", "__n", "__bytes", "__hash", "__shard", "__part", "__place", "__text", "__key", "__found", "__row", "size", "band", "row"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """``documents`` and ``labels`` with odd rows, near copies, shared passages and a text of 30,000 words."""
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(4)
    passage = prose(90, 8_001)
    rows = [*ODD, (50, prose(30_000, 50), "en", "s", None)]
    rows += [(1000 + i, t, "en", f"h{i % 5}", None) for i, (t, _) in enumerate(toxic_rows(600, 5, lambda r: r.choice(["grumblefoot", "snotwaffle"])))]
    rows += [(400 + i, " ".join("".join(rng.choice(list("ßöäüzwk"), 5)) for _ in range(40)), "de" if i % 3 else None, "h9", None) for i in range(40)]
    rows += [(500 + i, f"{prose(40, 9_000 + i)} {passage} {prose(30, 9_100 + i)}", "en", "h1", None) for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(1000 + i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (4, None), (9, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(1, "<html lang='de'><body>" + rows[-10][1] + "</body></html>", "http://a.b.de/x"), (2, None, None), (3, "", "nonsense"), (4, "<html><p>" + prose(60, 1) + "</p>", "https://c.en/")]
    spark.createDataFrame(pages, "page_id long, html string, url string").write.parquet(f"{at}/pages.parquet")
    return at


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def test_op1_against_word_by_word_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))

    def slow(text):
        words, weights = (text or "").split(), []
        for i, w in enumerate(words):
            plain = toxicity.folded(w)
            repeated = i > 0 and words[i - 1] == w
            weights.append(0.0 if repeated or not plain else float(np.mean([model.weight[b] for b in toxicity.grams([plain])[0]])))
        starts = toxicity.passages(len(words), model.passage).tolist()
        means = [sum(weights[a:b]) / (b - a) for a, b in zip(starts, [*starts[1:], len(words)], strict=True) if b > a]
        return 1 / (1 + math.exp(-(max(means, default=0.0) + model.bias)))

    got = queries.op1_toxicity(spark, folder).collect()
    by = {(r["doc_id"], r["text"]): slow(r["text"]) for r in documents(spark, folder)}
    assert sorted(round(r["score"], 6) for r in got) == pytest.approx(sorted(round(by[r["doc_id"], r["text"]], 6) for r in documents(spark, folder)), abs=2e-5)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], int(r["doc_id"] % 4 == 0)) for r in got if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.8


def test_op2_against_the_library(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048) for r in documents(spark, folder))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op2_token_counts(spark, folder).collect()) == want


def test_op3_against_all_pairs_of_documents(spark, folder):
    """Every run of 50 words and more that an earlier document has goes, and nothing else; equal paragraphs of fewer stay."""
    got = {r["doc_id"]: r for r in queries.op3_substring_dedup(spark, folder).collect() if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, folder) if r["doc_id"] is not None}
    first: dict[tuple, int] = {}
    for key in sorted(texts):
        words = texts[key].split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - passages.MIN_RUN + 1):
            if first.setdefault(tuple(words[i : i + passages.MIN_RUN]), key) < key:
                gone[i : i + passages.MIN_RUN] = True
        assert got[key]["removed_words"] == gone.sum()
        assert (got[key]["text"] or "").split() == [w for w, g in zip(words, gone, strict=True) if not g]
    assert sum(r["removed_words"] > 0 for r in got.values()) == 5  # four documents with the passage, and a copy


def test_op4_against_the_librarys_ids(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()
    want: dict[object, list] = {}
    for r in documents(spark, folder):
        want.setdefault(r["doc_id"], []).append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    got: dict[object, Counter] = {}
    places: dict[int, list] = {}
    for r in queries.op4_best_fit_packing(spark, folder).collect():
        got.setdefault(r["doc_id"], Counter())[r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(got) == set(want)
    for key, own in want.items():
        pieces: Counter = Counter()
        for ids in own:
            head = len(ids) % 1024 or 1024
            starts = [0, *range(head, len(ids), 1024)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                pieces[k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert got[key] == pieces
    total = 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(places) <= 1.05 * math.ceil(total / 1024) + 1


def test_op5_against_posteriors_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.learn(docs)
    names = [*model.languages, langid.UNKNOWN]
    k, rows = len(names), documents(spark, folder)
    likely = [model.likelihoods([r["text"] or ""])[0] for r in rows]
    guess = [None if not x.any() else int(x.argmax()) for x in likely]
    total = np.array([sum(g == i for g in guess) for i in range(k)], float)
    flat = (total + 1) / (total.sum() + k)

    def counts(column, value):
        return np.array([sum(g == i and r[column] == value for g, r in zip(guess, rows, strict=True)) for i in range(k)], float)

    want = []
    for r, x, g in zip(rows, likely, guess, strict=True):
        if g is None:
            want.append((str(r["doc_id"]), langid.UNKNOWN, 0.0, False))
            continue
        host = counts("source", r["source"]) if r["source"] is not None else np.zeros(k)
        prior = np.log((host + langid.HOST_STRENGTH * flat) / (host.sum() + langid.HOST_STRENGTH)) if host.sum() else np.log(flat)
        said = counts("lang", r["lang"]) if r["lang"] is not None else np.zeros(k)
        evidence = np.log((said + langid.EVIDENCE_STRENGTH / k) / (total + langid.EVIDENCE_STRENGTH)) if said.sum() else 0.0
        s = x + prior + evidence
        p = 1 / np.exp(s - s.max()).sum()
        best = names[int(s.argmax())]
        want.append((str(r["doc_id"]), best, round(float(p), 6), best != langid.UNKNOWN and p >= langid.CONFIDENT))
    got = queries.op5_language_id(spark, folder).filter("page_id IS NULL").collect()
    assert sorted((str(r["doc_id"]), r["language"], round(r["confidence"], 6), r["accepted"]) for r in got) == sorted(want)
    of = {r["page_id"]: (r["language"], r["accepted"]) for r in queries.op5_language_id(spark, folder).filter("page_id IS NOT NULL").collect()}
    assert of[1] != ("de", False) and of[2] == of[3] == ("und", False) and of[4] == ("en", True)


def test_columns_with_clashing_names_stay(spark, odd_docs):
    table = odd_docs
    for i, c in enumerate(CLASHING):
        table = table.withColumn(c, F.lit(i))
    model = toxicity.train([], [])
    made = {
        "token_counts": token_counts.count_tokens(table, public_tokenizers.path("word_bpe_49k.json")),
        "sharding": sharding.shard(table),
        "passages": passages.remove_repeated(table),
        "langid": langid.identify(table, langid.learn(odd_docs), declared=F.col("lang"), host=F.col("source")),
        "toxicity": toxicity.score(table, model),
    }
    for name, out in made.items():
        rows = out.collect()
        assert len(rows) == len(ODD), name
        assert all(r[c] == i for r in rows for i, c in enumerate(CLASHING)), name
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD), name


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs, folder):
    """Each stage by itself: nulls in all columns, blank, long and repeated texts, repeated rows, clashing columns, no rows."""
    extra = odd_docs
    for i, c in enumerate(CLASHING):
        extra = extra.withColumn(c, F.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, extra):
            out = written(stage(spark, docs, folder))
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
                kept = Counter(map(tuple, out.select(*SCHEMA_COLUMNS).collect()))
                given = Counter(map(tuple, docs.select(*SCHEMA_COLUMNS).collect()))
                if name != "substring_dedup":
                    assert not kept - given, name
        assert written(stage(spark, no_docs, folder)).count() == 0, name
    by = {name: stage for name, stage in corpus_pipeline.STAGES}
    texts = sorted(str(r["text"]) for r in written(by["simhash_near_dedup"](spark, odd_docs, folder)).select("text").collect())
    assert texts == sorted(str(r[1]) for r in ODD if r[0] in (1, 4, 5, 6, 7, 9))[: len(texts)] or len(texts) == 6


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
