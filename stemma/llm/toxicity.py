"""Toxicity by subword bags, trained in numpy.

A word is the bag of its character n-grams (and itself), hashed into buckets; a
passage is the average of its words' averaged bucket vectors, and a linear
softmax tells toxic from clean passages.  Bucket vectors and softmax are trained
jointly.  A misspelt or unseen word shares most n-grams with words seen.

A document is judged by its most toxic passage of some words, so that length
does not dilute; training finds that passage anew in each round, and for clean
documents adds a passage at random.  How many words, and in how many training
documents an n-gram must be lest single ones are learnt by heart, is chosen by
inner validation: models of each of SETTINGS learn from one half of the training
documents and score the other; the best setting is trained again on all, and the
bound between the classes is the one that parts these scores best.  As the softmax is linear, a trained model
is one number for each bucket, and scoring a word is a mean over its n-grams.

Labels are learnt from at most SAMPLE documents of each class (those with the
least hash of their key), whatever the size of the corpus; scoring covers every
word of every document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.encoding import text_slices
from stemma.llm.shared import quoted, sampled, unused, with_replaced

#: Labelled documents to learn from, of each class at most.
SAMPLE = 1500
#: Characters of a class's sample from which no more documents are added.
SAMPLE_CHARS = 32_000_000
BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4, 5, 6)
ROUNDS = 20
#: Words of a passage, and the share of the training documents that an n-gram must be in, to choose from.
SETTINGS = ((5, 1 / 30), (8, 1 / 60))
#: Training documents of each class from which there is a choice; with fewer the first of SETTINGS holds.
ENOUGH = 16
#: Errors at toxic documents that one at a clean document weighs, each as a share of its class.
CLEAN = 2
#: Rounds on passages at random before the most toxic passage is trusted, and steps of the vectors.
PLAIN_ROUNDS = 6
STEP = 0.3
#: Averages are small where one word of a passage matters; the softmax sees them this much larger.
SCALE = 200.0
#: Unseen misspellings score lower than what was learnt, so the bound is nearer to clean documents.
GAP = 0.4
CACHE_WORDS = 200_000
EDGES = "\"'.,;:!?()[]{}<>|*#$%&-_/\\~`+=^@"


def folded(token: str) -> str:
    """A token between spaces as the model sees it: lower case, without marks at its ends."""
    return token.lower().strip(EDGES)


def grams(words: list[str], buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, word after word, and how many each word has; none stands for a whole word, so that misspellings share all that a word's weight is made of."""
    parts, counts = [], np.zeros(len(words), np.int64)
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        classes.setdefault((len(w) + 2).bit_length(), []).append(i)
    for at in (a[k : k + 8_000] for a in classes.values() for k in range(0, len(a), 8_000)):
        marked = ["<" + words[i] + ">" for i in at]
        size = np.fromiter(map(len, marked), np.int64, len(at))
        code = np.zeros((len(at), size.max()), np.uint64)
        code[np.arange(size.max()) < size[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        with np.errstate(over="ignore"):
            whole = np.zeros(len(at), np.uint64)
            for k in range(code.shape[1]):
                whole = np.where(k < size, whole * np.uint64(1_000_003) + code[:, k] + np.uint64(1), whole)  # of the word alone
            hashes, valid = [whole[:, None]], [(size < sizes[0])[:, None]]  # a word too short for n-grams is one itself
            for n in sizes:
                if code.shape[1] >= n:
                    h = np.full((len(at), code.shape[1] - n + 1), n, np.uint64)
                    for k in range(n):
                        h = h * np.uint64(1_000_003) + code[:, k : code.shape[1] - n + 1 + k]
                    hashes.append(h)
                    valid.append(np.arange(h.shape[1]) <= (size - n)[:, None])
            h = np.concatenate(hashes, 1) * np.uint64(0x9E3779B97F4A7C15)
        good = np.concatenate(valid, 1)
        counts[at] = good.sum(1)
        bucket = (h >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int32)
        parts.append((at, bucket[good]))
    start, flat = np.cumsum(counts) - counts, np.zeros(counts.sum(), np.int32)
    for at, own in parts:
        n = counts[at]
        flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = own
    return flat, counts


def passages(n: int, size: int) -> np.ndarray:
    """Starts of passages of ``size`` words; the last one may be half as long again."""
    return np.arange(0, max(1, n - size // 2), size)


@dataclass
class Model:
    """One number for each bucket, the constant, and the words of a passage."""

    weight: np.ndarray
    bias: float
    passage: int = SETTINGS[0][0]

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def word_weights(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        bucket, counts = grams(words, len(self.weight))
        return np.add.reduceat(self.weight[bucket], np.cumsum(counts) - counts) / counts

    def scores(self, texts: list[str]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.tops(texts) + self.bias, -500, 500)))).tolist()

    def tops(self, texts: list[str]) -> np.ndarray:
        """Of each text the weight of its most toxic passage."""
        split = [t.split() for t in texts]
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        missing = list({w for words in split for w in words if w not in known})
        for k in range(0, len(missing), 8_000):
            part = missing[k : k + 8_000]
            plain = [folded(w) for w in part]
            known.update(zip(part, np.where([w != "" for w in plain], self.word_weights(plain), 0.0).tolist(), strict=True))
        out = []
        for words in split:
            top = 0.0
            if words:
                value = np.fromiter(map(known.__getitem__, words), float, len(words))
                same = np.fromiter(map(hash, words), np.int64, len(words))
                value[1:][same[1:] == same[:-1]] = 0.0  # a word said again at once adds nothing
                starts = passages(len(words), self.passage)
                top = (np.add.reduceat(value, starts) / np.diff([*starts, len(words)])).max()
            out.append(top)
        return np.array(out, float)


def train(texts: list[str], toxic: list[int]) -> Model:
    """The model of the one of SETTINGS that tells most documents of the other half apart, trained on all documents; its bound too is that of the halves."""
    labels = np.asarray(toxic, np.int64)
    half = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        half[labels == y] = np.arange((labels == y).sum()) % 2
    if min((labels == y).sum() for y in (0, 1)) < ENOUGH:
        return fitted(texts, toxic, *SETTINGS[0])
    best, setting, bound = -1.0, SETTINGS[0], 0.0
    for s in SETTINGS:
        top = np.zeros(len(labels))
        for h in (0, 1):
            own, rest = np.flatnonzero(half != h), np.flatnonzero(half == h)
            top[rest] = fitted([texts[i] for i in own], labels[own].tolist(), *s).tops([texts[i] for i in rest])
        if (worth := apart(top, labels)) > best:
            best, setting, bound = worth, s, threshold(top, labels)
    model = fitted(texts, toxic, *setting)
    return Model(model.weight, -bound, model.passage)


def apart(score: np.ndarray, labels: np.ndarray) -> float:
    """Share of pairs of a toxic and a clean document in which the toxic one scores higher, ties half."""
    toxic, clean = score[labels == 1], np.sort(score[labels == 0])
    return float((np.searchsorted(clean, toxic) + np.searchsorted(clean, toxic, "right")).mean() / (2 * len(clean)))


def fitted(texts: list[str], toxic: list[int], size: int, share: float, seed: int = 7) -> Model:
    """Joint training of bucket vectors and softmax; without both classes, the share of toxic rows is every score."""
    labels = np.asarray(toxic, np.int64)
    if len(set(labels.tolist())) < 2:
        part = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.01
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(part / (1 - part))))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    nothing = vocabulary.setdefault("", 0)
    docs = [np.array([vocabulary.setdefault(folded(w), len(vocabulary)) for w in t.split()] or [nothing], np.int32) for t in texts]
    for d in docs:
        d[1:][d[1:] == d[:-1]] = nothing
    bucket, counts = grams(list(vocabulary))
    start = np.cumsum(counts) - counts
    spread = np.zeros(BUCKETS)  # training documents that have a bucket
    for d in docs:
        words = np.unique(d)
        per = counts[words]
        spread[np.unique(bucket[np.repeat(start[words] - (np.cumsum(per) - per), per) + np.arange(per.sum())])] += 1
    common = (spread >= max(2, share * len(docs)))[:, None]
    table = (rng.standard_normal((BUCKETS, DIM)) * 0.1 * common).astype(np.float32)
    soft = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
    bias = np.zeros(2, np.float32)
    speed_t, speed_s, speed_b = np.full(BUCKETS, 1e-3, np.float32), np.full((DIM, 2), 1e-2, np.float32), np.full(2, 1e-2, np.float32)
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).clip(0.2, 5)
    for turn in range(ROUNDS):
        order = rng.permutation(len(docs))
        worth = None
        for k in range(0, len(order), 64):
            if k % 1024 == 0 and turn >= PLAIN_ROUNDS:
                worth = np.add.reduceat((table @ (soft[:, 1] - soft[:, 0]))[bucket], start) / counts
                worth[nothing] = 0
            chosen, target, weight = [], [], []
            for i in order[k : k + 64]:
                d, starts = docs[i], passages(len(docs[i]), size)
                ends = [*starts[1:], len(d)]
                if worth is None:
                    picks = rng.choice(len(starts), min(4, len(starts)), replace=False)
                else:
                    mean = np.add.reduceat(worth[d], starts) / np.diff([*starts, len(d)])
                    picks = {int(mean.argmax())} if labels[i] else {int(mean.argmax()), int(rng.integers(len(starts)))}
                for s in picks:
                    chosen.append(d[starts[s] : ends[s]])
                    target.append(labels[i])
                    weight.append(balance[i] / len(picks))
            long = np.array([len(c) for c in chosen])
            words, place = np.unique(np.concatenate(chosen), return_inverse=True)
            per = counts[words]
            flat = bucket[np.repeat(start[words] - (np.cumsum(per) - per), per) + np.arange(per.sum())]
            vector = np.add.reduceat(table[flat], np.cumsum(per) - per) / per[:, None]
            vector[words == nothing] = 0
            passage = SCALE * np.add.reduceat(vector[place], np.cumsum(long) - long) / long[:, None]
            logit = passage @ soft + bias
            likely = np.exp(logit - logit.max(1, keepdims=True))
            likely /= likely.sum(1, keepdims=True)
            slope = (likely - np.eye(2)[target]) * np.array(weight)[:, None] / len(chosen)
            g_soft, g_bias = passage.T @ slope, slope.sum(0)
            g_word = np.zeros((len(words), DIM))
            np.add.at(g_word, place, np.repeat(SCALE * (slope @ soft.T) / long[:, None], long, axis=0))
            g_word[words == nothing] = 0
            touched, where = np.unique(flat, return_inverse=True)
            g_table = np.zeros((len(touched), DIM))
            np.add.at(g_table, where, np.repeat(g_word / per[:, None], per, axis=0))
            speed_s += g_soft**2
            speed_b += g_bias**2
            g_table *= common[touched]
            speed_t[touched] += (g_table**2).sum(1)
            soft -= (0.5 * g_soft / np.sqrt(speed_s)).astype(np.float32)
            bias -= (0.2 * g_bias / np.sqrt(speed_b)).astype(np.float32)
            table[touched] -= (STEP * g_table / np.sqrt(speed_t[touched])[:, None]).astype(np.float32)
    weight = (SCALE * (table @ (soft[:, 1] - soft[:, 0]))).astype(np.float32)
    worth = np.add.reduceat(weight[bucket], start) / counts
    worth[nothing] = 0
    top = np.array([(np.add.reduceat(worth[d], passages(len(d), size)) / np.diff([*passages(len(d), size), len(d)])).max() for d in docs])
    return Model(weight, -threshold(top, labels), size)


def threshold(value: np.ndarray, labels: np.ndarray) -> float:
    """Where the classes part with the fewest errors, those at clean documents weighing CLEAN times as much; in a gap, GAP of the way from the clean side."""
    order = np.argsort(value, kind="stable")
    y = labels[order]
    missed, spared = np.cumsum(y) / max(y.sum(), 1), np.cumsum(1 - y) / max((1 - y).sum(), 1)
    errors = np.where(np.diff(value[order], append=np.inf) > 0, missed + CLEAN * (1 - spared), np.inf)[:-1]
    if not len(errors) or not np.isfinite(errors).any():
        return float(value[0])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    i = best[len(best) // 2]
    return float(value[order][i] + GAP * (value[order][i + 1] - value[order][i]))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample`` labelled documents of each class that aren't held out, while they have under ``chars`` characters.

    Keys or labels that are null are no examples; a key labelled twice has its
    highest label; null texts are empty.
    """
    known = labels.select(quoted(key).alias("k"), quoted(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("k").agg(F.max("y").alias("y")).filter(~held_out(F.col("k")))
    chosen = sampled(known, "y", sample)  # at most two samples: small enough for every executor
    own = docs.select(quoted(key).alias("k"), quoted(text).cast("string").alias("text")).join(F.broadcast(chosen), "k")
    before = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(W.partitionBy("y").orderBy(F.xxhash64("k"), "k", "text").rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < chars)
    rows = own.orderBy(F.xxhash64("k"), "k", "text").toPandas()
    return train([t or "" for t in rows["text"]], rows["y"].tolist())


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted", carry: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5) to each row.

    Null, empty and blank texts have no words, so only the model's constant
    speaks; very long texts are scored whole; repeated rows are scored each;
    input columns named like an output are replaced; an empty table stays empty.
    ``carry``: the input columns to return, all by default.
    """
    carry = with_replaced(df, score, predicted) if carry is None else carry
    held = unused(df, "__text")
    source = df.select(*[quoted(c) for c in carry], quoted(text).cast("string").alias(held))
    schema = T.StructType([*[source.schema[c] for c in carry], T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.passage))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model(*shared.value)
        own = _MODELS[name]
        for batch in batches:
            for part, texts in text_slices(batch, held):
                value = own.scores(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(value), pa.array([int(v >= 0.5) for v in value], pa.int32())], names=[*carry, score, predicted])

    return source.mapInArrow(run, schema)


_MODELS: dict[str, Model] = {}
