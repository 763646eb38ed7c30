"""A log-bilinear language model by noise-contrastive estimation, and the scores of texts under it.

Tokens are words in lower case and an end.  The ``WORDS`` most frequent have
outputs of their own; of all others the network predicts a class by their last
two letters, and within a class a word has its add-one share of the counts, so
that every token of every text has a normalised probability.  A context is the
two tokens before: each has a vector, each place a matrix, their sum is the
prediction, and a token's score its product with the token's output vector,
plus a constant.

Counts cover all training tokens and stay in Spark; only words from a count on
that few words reach are sent to every task, the others meet their counts in a
join.  All training texts are learnt from, in rounds: in each, every task goes
on from the same parameters over its share of the round's texts, with noise
words drawn once for a batch of tokens, and the tasks' parameters are averaged
by weight, in a tree of sums.  Scoring normalises over all outputs, by matrix
products of blocks of distinct contexts with all output vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.shared import quoted, unused, with_replaced, written
from stemma.llm.words import codes_of, lower, slices, words_of

#: Outputs of frequent words and of classes of all others; output 0 is the end of a text.
WORDS, CLASSES = 959, 64
OUTPUTS = 1 + CLASSES + WORDS
#: The place before a text begins, in contexts only.
START = OUTPUTS
DIM, NOISE, BATCH = 24, 64, 1024
#: Rounds, each over another share of the texts, and tokens that training sees at least, by going over a share again.
ROUNDS, LEAST_TOKENS, MOST_PASSES = 4, 4_000_000, 8
STEP = 0.12
#: Words, and bytes of a word, that are sent to every task at most: 12 MB.
HEAD, HEAD_BYTES = 1 << 18, 48
#: Bytes of texts that are counted together, and of token numbers that are scored together.
COUNT_BYTES, SCORE_BYTES = 16 << 20, 4 << 20
#: Contexts that meet all outputs in one product.
BLOCK = 2048
FAN = 16


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n`` over all texts; the empty word is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for part in slices(batch, "text", COUNT_BYTES):
                code, words = codes_of(words_of(lower(part.column("text")))[1])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)))], names=["word", "n"])
        if ends:
            yield pa.RecordBatch.from_pydict({"word": pa.array([""]), "n": pa.array([ends])})

    own = docs.select(F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _classes(words: pa.Array) -> np.ndarray:
    """Outputs of words without one of their own: CRC-32 of their last two characters."""
    code, ends = codes_of(pc.utf8_slice_codeunits(words, -2, None))
    return (1 + np.array([zlib.crc32(x.as_py().encode()) % CLASSES for x in ends], np.int64))[code] if len(ends) else np.zeros(0, np.int64)


@dataclass
class Vocabulary:
    """Counts of training tokens: in Spark all, in hand those of frequent words and the sums by output."""

    counts: DataFrame = field(repr=False)
    tokens: int
    distinct: int
    least: int
    words: pa.Array = field(repr=False)
    seen: np.ndarray = field(repr=False)
    output: np.ndarray = field(repr=False)
    by_output: np.ndarray = field(repr=False)
    distinct_in: np.ndarray = field(repr=False)

    def in_head(self) -> Column:
        return (F.col("n") >= self.least) & (F.octet_length("word") <= HEAD_BYTES)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a table (``word``, ``n``) that is stored."""
    eighth = F.floor(F.log2("n") * 8).cast("int")
    bins = counts.groupBy(eighth.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.sum("n").alias("tokens"), F.count_if(F.octet_length("word") <= HEAD_BYTES).alias("short")).orderBy(F.desc("bin")).collect()  # under 512
    least, taken = 1 << 62, 0
    for b in bins:
        taken += b["short"]
        if taken > HEAD:
            break
        least = b["least"]
    head = counts.filter((F.col("n") >= least) & (F.octet_length("word") <= HEAD_BYTES)).toArrow()  # HEAD rows at most
    words = head.column("word").combine_chunks().cast(pa.string())
    seen = head.column("n").to_numpy().astype(np.int64)
    by_name = np.empty(len(words), np.int64)
    by_name[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    ends = pc.equal(words, "").to_numpy(zero_copy_only=False)
    order = np.lexsort((by_name, -seen))
    own = order[~ends[order]][:WORDS]
    output = _classes(words)
    output[own] = 1 + CLASSES + np.arange(len(own))
    output[ends] = 0
    letters = F.right("word", F.lit(2))
    plain = counts.filter("word <> ''").join(F.broadcast(counts.sparkSession.createDataFrame([(w.as_py(),) for w in words.take(pa.array(own))], "word string")), "word", "left_anti")  # WORDS rows
    sums = plain.groupBy((1 + F.crc32(letters.cast("binary")) % CLASSES).alias("output")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # CLASSES rows
    by_output, distinct_in = np.zeros(OUTPUTS, np.int64), np.zeros(OUTPUTS, np.int64)
    for r in sums:
        by_output[r["output"]], distinct_in[r["output"]] = r["n"], r["words"]
    by_output[1 + CLASSES + np.arange(len(own))] = seen[own]
    by_output[0] = seen[ends].sum()
    return Vocabulary(counts, sum(b["tokens"] for b in bins), sum(b["words"] for b in bins), least, words, seen, output, by_output, distinct_in)


def encoded(docs: DataFrame, known: Vocabulary, carry: list[str], text: str = "text") -> DataFrame:
    """``carry``, ``row``, ``n_tokens``, ``n_head`` and ``head_log`` (how many tokens are in the head, sum of log10(count + 1)), ``in_class`` (log10 of their shares in their classes; of other words only what is subtracted), ``outputs`` (16-bit numbers) and ``tail`` (all other words)."""
    held = unused(docs.select(*[quoted(c) for c in carry]), "__text")
    source = docs.select(*[quoted(c) for c in carry], F.coalesce(quoted(text).cast("string"), F.lit("")).alias(held))
    extra = "n_tokens long, n_head long, head_log double, in_class double, outputs binary, tail array<string>"
    schema = T.StructType([*[source.schema[c] for c in carry], *T.StructType.fromDDL(extra)])
    share = np.log10(known.by_output + known.distinct_in + 1.0)
    share[[0, *range(1 + CLASSES, OUTPUTS)]] = 0
    shared = docs.sparkSession.sparkContext.broadcast((known.words, known.seen, known.output, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, output, share = shared.value
        log = np.log10(seen + 1.0)
        ends = pc.index_in(pa.scalar(""), value_set=words).as_py()
        for batch in batches:
            for part in slices(batch, held):
                sizes, flat = words_of(lower(part.column(held)))
                code, names = codes_of(flat)
                at = pc.fill_null(pc.index_in(names, value_set=words), -1).to_numpy(zero_copy_only=False) if len(words) else np.full(len(names), -1)
                to = _classes(names)
                to[at >= 0] = output[at[at >= 0]]
                value = np.where(at >= 0, log[at] if len(log) else 0.0, 0.0)
                docs_here = len(sizes)
                doc = np.repeat(np.arange(docs_here), sizes)
                line = np.zeros(len(flat) + docs_here, np.int16)
                line[np.arange(len(flat)) + doc] = to[code]
                cut = 2 * np.concatenate([[0], np.cumsum(sizes + 1)])
                inside = (at >= 0)[code]
                rare = (to[code] > 0) & (to[code] <= CLASSES)
                n_head = np.bincount(doc, inside, docs_here).astype(np.int64) + (ends is not None)
                head_log = np.bincount(doc, value[code], docs_here).astype(float) + (log[ends] if ends is not None else 0.0)
                # what is subtracted for the shares of classes, and added for counts of their words in the head
                in_class = np.bincount(doc, np.where(rare, value[code] - share[to[code]], 0.0), docs_here).astype(float)
                out = flat.filter(pa.array(~inside))
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, ~inside, docs_here))]).astype(np.int32)), out)
                binary = pa.Array.from_buffers(pa.binary(), docs_here, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(line)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(sizes + 1), pa.array(n_head), pa.array(head_log), pa.array(in_class), binary, tail], names=schema.names)

    return source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def contexts(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of texts: two tokens before, one before, the token."""
    size = np.array([len(x) for x in lines])
    flat = np.concatenate([np.full(2, START, np.int16), *lines]).astype(np.int64)
    one, two, token = flat[1:-1].copy(), flat[:-2].copy(), flat[2:]
    begin = np.cumsum(size) - size
    one[begin] = two[begin] = START
    second = begin[size > 1] + 1
    two[second] = START
    return two, one, token


@dataclass
class Model:
    """Vectors of context tokens, of outputs, constants of outputs, and a matrix for each place."""

    inputs: np.ndarray
    outputs: np.ndarray
    constant: np.ndarray
    places: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.inputs, self.outputs, self.constant, self.places

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        shapes = [(OUTPUTS + 1, DIM), (OUTPUTS, DIM), (OUTPUTS,), (2, DIM, DIM)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return Model(*[x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)])

    @staticmethod
    def new(by_output: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        share = prior(by_output)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return Model(draw(OUTPUTS + 1, DIM), draw(OUTPUTS, DIM), np.log(share).astype(np.float32), np.stack([np.eye(DIM), np.eye(DIM)]).astype(np.float32))

    def predictions(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.inputs[two] @ self.places[0] + self.inputs[one] @ self.places[1]

    def log_probabilities(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural logarithms of each token's share of all outputs after its context."""
        pair, where = np.unique(two * (OUTPUTS + 1) + one, return_inverse=True)
        all_of = np.empty(len(pair), np.float32)
        q = self.predictions(pair // (OUTPUTS + 1), pair % (OUTPUTS + 1))
        for k in range(0, len(pair), BLOCK):
            logit = q[k : k + BLOCK] @ self.outputs.T
            logit += self.constant
            top = logit.max(1)
            logit -= top[:, None]
            all_of[k : k + BLOCK] = top + np.log(np.exp(logit, out=logit).sum(1))
        out = np.empty(len(token))
        for k in range(0, len(token), 1 << 16):
            at = where[k : k + (1 << 16)]
            to = token[k : k + (1 << 16)]
            out[k : k + (1 << 16)] = np.einsum("ij,ij->i", q[at], self.outputs[to]) + self.constant[to] - all_of[at]
        return out


def prior(by_output: np.ndarray) -> np.ndarray:
    return (by_output + 1.0) / (by_output.sum() + OUTPUTS)


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each index."""
    order = np.argsort(index, kind="stable")
    own = index[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(rows[order], first, axis=0)


def learn_batch(model: Model, speed: Model, two: np.ndarray, one: np.ndarray, token: np.ndarray, share: np.ndarray, noise: np.ndarray, step: float) -> None:
    """One step of noise-contrastive estimation on a batch of tokens, against the same noise for all of them."""
    n, k = len(token), len(noise)
    a, b = model.inputs[two], model.inputs[one]
    q = a @ model.places[0] + b @ model.places[1]
    real, other = model.outputs[token], model.outputs[noise]
    log_share = np.log(k * share).astype(np.float32)
    up = np.einsum("ij,ij->i", q, real) + model.constant[token] - log_share[token]
    down = q @ other.T + (model.constant[noise] - log_share[noise])
    up = 1 / (1 + np.exp(np.clip(up, -30, 30)))  # what the true token lacks
    down = -1 / (1 + np.exp(-np.clip(down, -30, 30)))
    up, down = (up / n).astype(np.float32), (down / n).astype(np.float32)
    g_q = up[:, None] * real + down @ other

    def move(value: np.ndarray, speed: np.ndarray, at, g: np.ndarray) -> None:
        speed[at] += g * g
        value[at] += step * g / np.sqrt(speed[at])

    index, g = _summed(np.concatenate([token, noise]), np.concatenate([np.column_stack([up[:, None] * q, up]), np.column_stack([down.T @ q, down.sum(0)])]))
    move(model.outputs, speed.outputs, index, g[:, :DIM])
    move(model.constant, speed.constant, index, g[:, DIM])
    g_a, g_b = g_q @ model.places[0].T, g_q @ model.places[1].T
    move(model.places, speed.places, slice(None), np.stack([a.T @ g_q, b.T @ g_q]))
    index, g = _summed(np.concatenate([two, one]), np.concatenate([g_a, g_b]))
    move(model.inputs, speed.inputs, index, g)


def trained(coded: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Model:
    """A model of the texts whose token numbers are the column ``outputs`` of a stored table with ``row``."""
    spark = coded.sparkSession
    model = Model.new(known.by_output)
    if not known.tokens:
        return model
    share = prior(known.by_output)
    state = np.concatenate([model.flat(), np.full(len(model.flat()), 1e-6, np.float32)])
    passes = max(1, min(MOST_PASSES, -(-LEAST_TOKENS // known.tokens)))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((state, share))
        step = STEP * (1 - turn / (rounds + 1))

        def train(batches: Iterator[pa.RecordBatch], shared=shared, step=step, turn=turn) -> Iterator[pa.RecordBatch]:
            (start, share), weight, name = shared.value, 0, None
            half = len(start) // 2
            model, speed = Model.of(start[:half].copy()), Model.of(start[half:].copy())
            bound = np.cumsum(share)
            for batch in batches:
                for part in slices(batch, "outputs", SCORE_BYTES):
                    name = part.column("row")[0].as_py() if name is None else name
                    rng = np.random.default_rng([turn, part.column("row")[0].as_py()])
                    two, one, token = contexts([np.frombuffer(x.as_buffer(), np.int16) for x in part.column("outputs")])
                    weight += len(token)
                    for _ in range(passes):
                        order = rng.permutation(len(token))
                        noise = np.searchsorted(bound, rng.random((-(-len(order) // BATCH), NOISE)) * bound[-1]).clip(0, OUTPUTS - 1)
                        for i, k in enumerate(range(0, len(order), BATCH)):
                            at = order[k : k + BATCH]
                            learn_batch(model, speed, two[at], one[at], token[at], share, noise[i], step)
            if weight:
                own = np.concatenate([model.flat(), speed.flat()]).astype(np.float64) * weight
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([weight]), pa.array([own.astype("<f8").tobytes()], pa.binary())], names=["part", "weight", "state"])

        texts = coded.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn).select("row", "outputs")
        total, weight = _total(written(texts.mapInArrow(train, "part long, weight long, state binary")))
        if weight:
            state = (total / weight).astype(np.float32)
        shared.unpersist()
    return Model.of(state[: len(state) // 2])


def _total(parts: DataFrame) -> tuple[np.ndarray, int]:
    """Sum of the tasks' states and weights, in a tree with FAN branches; the same for the same parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["part"], r["weight"], r["state"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        if rows:
            total = np.zeros(len(rows[0][2]) // 8)
            for _, _, state in rows:
                total += np.frombuffer(state, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([sum(r[1] for r in rows)]), pa.array([total.tobytes()], pa.binary())], names=["part", "weight", "state"])

    count = parts.count()
    while count > FAN:
        count = -(-count // FAN)
        parts = parts.repartition(count, "part").mapInArrow(add, parts.schema)
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    return (sum(np.frombuffer(r["state"], "<f8") for r in rows) if rows else np.zeros(0)), sum(r["weight"] for r in rows)


def scored(coded: DataFrame, known: Vocabulary, model: Model, carry: list[str]) -> DataFrame:
    """``carry``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of a stored table of ``encoded`` texts."""
    shared = coded.sparkSession.sparkContext.broadcast(model.parts())
    own = coded.select(*[quoted(c) for c in carry], "row", "n_tokens", "n_head", "head_log", "in_class", "outputs")
    schema = T.StructType([*[f for f in own.schema if f.name != "outputs"], T.StructField("network", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "outputs", SCORE_BYTES):
                lines = [np.frombuffer(x.as_buffer(), np.int16) for x in part.column("outputs")]
                size = np.array([len(x) for x in lines])
                value = model.log_probabilities(*contexts(lines))
                total = np.add.reduceat(value, np.cumsum(size) - size) / np.log(10)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in schema.names[:-1]], pa.array(total)], names=schema.names)

    word = coded.select("row", F.explode("tail").alias("word"))
    rare = known.counts.filter(~known.in_head())
    tail = word.join(rare, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_log"), F.count("n").alias("n_tail"))
    whole = own.mapInArrow(run, schema).join(tail, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(known.tokens + known.distinct + 1))
    return whole.select(
        *[quoted(c) for c in carry],
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        base.alias("base_score"),
        (F.col("network") + F.col("in_class") + tail_log).alias("score"),
    )


def language_model_scores(docs: DataFrame, learnt: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` to each row, learning from the rows where ``learnt`` is true.

    ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over a text's
    tokens, c being a token's count among the N training tokens of V kinds;
    ``score`` is the network's log10 probability of the text.  Null, empty and
    blank texts are an end alone; texts of any length are scored whole; repeated
    rows are learnt from and scored each; rows where ``learnt`` is null are not
    learnt from; without any training row every c, N and V is 0; an empty table
    stays empty; input columns named like an output are replaced.  ``carry``: the
    input columns to return, all by default.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carry = with_replaced(docs, *names) if carry is None else carry
    source = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(carry)], quoted(text).cast("string").alias("text"), F.coalesce(learnt, F.lit(False)).alias("learnt"))
    held = [f"c{i}" for i in range(len(carry))]
    known = vocabulary(written(counted(source.filter("learnt"))))
    coded = written(encoded(source, known, [*held, "learnt"]))
    model = trained(coded.filter("learnt"), known)
    result = scored(coded, known, model, held).withColumn("train_tokens", F.lit(known.tokens).cast("long"))
    return result.select(*[F.col(h).alias(c) for h, c in zip(held, carry, strict=True)], *names)
