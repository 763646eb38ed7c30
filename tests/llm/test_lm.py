"""Language-model scores: counts against brute force, probabilities that sum to one, held-out texts that gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemma.llm import lm, queries
from stemma.llm.shared import written
from tests.llm.conftest import ODD, SCHEMA, prose

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text):
    return (text or "").encode().translate(LOW).split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lm"))
    rng = np.random.default_rng(2)
    two = ["red green blue".split(), "one two three".split()]  # each word follows its own kind
    rows = [*ODD, *[(100 + i, " ".join(rng.choice(two[i % 2], 60)), "en", "s", None) for i in range(200)], *[(400 + i, prose(80, i), "en", "s", None) for i in range(60)], (900, "x" * 100 + " y" * 70_000, "en", "s", None)]
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("s")).withColumn("learnt", F.lit(0)).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module", params=[lm.HEAD, 40])
def results(request, spark, folder):
    """With all words sent to the tasks, and with most words met in a join."""
    was, lm.HEAD = lm.HEAD, request.param
    try:
        return queries.op13_lm_scores(spark, folder).collect()
    finally:
        lm.HEAD = was


def test_op13_counts_against_brute_force(spark, folder, results):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for r in docs:
        if not held(r["doc_id"]):
            count.update(words(r["text"]))
            count[None] += 1
    n, kinds = sum(count.values()), len(count)
    want = []
    for r in docs:
        own = [*words(r["text"]), None]
        base = sum(math.log10((count[w] + 1) / (n + kinds + 1)) for w in own)
        want.append((str(r["doc_id"]), held(r["doc_id"]), len(own), sum(count[w] > 0 for w in own), n, round(base, 4)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in results) == sorted(want)


def test_op13_learns_what_follows(results):
    """Held-out texts of two kinds of words: the words before tell the kind, which halves the choice."""
    own = [r for r in results if r["held_out"] and 100 <= (r["doc_id"] or 0) < 300]
    assert len(own) > 15
    tokens = sum(r["n_tokens"] for r in own)
    assert sum(r["score"] for r in own) / tokens > math.log10(1 / 3) - 0.16
    assert all(r["score"] > r["base_score"] + 0.2 * r["n_tokens"] for r in own)
    assert all(r["score"] < 0 for r in results)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = lm.Model.new(np.arange(lm.OUTPUTS), 3)
    model.outputs *= 20
    for two, one in rng.integers(0, lm.OUTPUTS + 1, (5, 2)):
        every = np.arange(lm.OUTPUTS)
        assert np.exp(model.log_probabilities(np.full(lm.OUTPUTS, two), np.full(lm.OUTPUTS, one), every)).sum() == pytest.approx(1, abs=1e-4)


def test_shares_of_a_class_sum_to_one(spark):
    """All training words of a class and one unseen word fill it."""
    texts = [(i, f"w{i}ab " * (i % 5 + 1) + "often " * 3) for i in range(1200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = lm.vocabulary(written(lm.counted(docs)))
    coded = lm.encoded(spark.createDataFrame([(i, t.split()[0]) for i, t in texts] + [(-1, "neverab")], "doc_id long, text string"), known, ["doc_id"]).collect()
    rare = [r for r in coded if r["in_class"] != 0 or r["tail"]]
    assert 1200 - lm.WORDS <= len(rare) <= 1203 - lm.WORDS
    c = lm._classes(pa.array(["neverab"]))[0]
    share = math.log10(known.by_output[c] + known.distinct_in[c] + 1)
    unseen = [r for r in rare if r["doc_id"] == -1]
    assert unseen[0]["tail"] == ["neverab"] and unseen[0]["in_class"] == pytest.approx(-share)
    assert sum(10 ** r["in_class"] for r in rare) == pytest.approx(1, abs=1e-9)


def test_noise_contrastive_step_follows_its_gradient():
    """The step raises the objective that it is the gradient of."""
    rng = np.random.default_rng(4)
    share = lm.prior(rng.integers(1, 50, lm.OUTPUTS))
    two, one, token, noise = (rng.integers(0, lm.OUTPUTS, n) for n in (256, 256, 256, 16))

    def objective(m):
        q = m.predictions(two, one)
        up = (q * m.outputs[token]).sum(1) + m.constant[token] - np.log(16 * share[token])
        down = q @ m.outputs[noise].T + m.constant[noise] - np.log(16 * share[noise])
        return -np.log1p(np.exp(-up)).mean() - np.log1p(np.exp(down)).sum(1).mean()

    model = lm.Model.new(share * 1e6)
    speed = lm.Model.of(np.full(len(model.flat()), 1e-6, np.float32))
    worth = [objective(model)]
    for _ in range(30):
        lm.learn_batch(model, speed, two, one, token, share, noise, 0.05)
        worth.append(objective(model))
    assert worth[-1] > worth[0] + 0.5


def test_nothing_to_learn_from(spark, no_docs):
    assert lm.language_model_scores(no_docs, F.lit(True)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, 4)], "doc_id long, text string, score int")
    got = sorted(map(tuple, lm.language_model_scores(docs, F.lit(None).cast("boolean")).drop("score").collect()), key=str)
    assert got == [(1, "a b", 3, 0, 0, 0.0), (2, None, 1, 0, 0, 0.0)]
