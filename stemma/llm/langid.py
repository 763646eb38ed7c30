"""Language identification by fusing evidence in the manner of Bayes.

log posterior = log prior of the host + log likelihood of the text + of the
declared markup language + of the address suffix.

* Text: words' character n-grams under a smoothed model for each language, each
  word weighing as one n-gram; a flat model stands for "no known language".
* Declared language and suffix: how often each value goes with each language,
  by grouped aggregation over all rows (language: the text's own best guess).
* Host: counts of languages for each host, smoothed by those of its domain,
  these by the table's, so a host with few pages leans on its domain.

The first pass reads texts and leaves a small row of likelihoods for each; the
counts and the fusion are DataFrame operations on those rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.encoding import text_slices
from stemma.llm.shared import few_or_shuffled, quoted, sampled, with_replaced, written
from stemma.llm.toxicity import folded, grams

#: Labelled texts to learn from, of each language at most.
SAMPLE = 400
#: Characters of a language's sample from which no more texts are added.
SAMPLE_CHARS = 4_000_000
#: Languages whose samples the driver holds at once.
TOGETHER = 32
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
SMOOTHING = 0.1
#: Rows that a domain's, and a table's, language shares count as.
HOST_STRENGTH = 10.0
#: Rows that a value's even shares count as.
EVIDENCE_STRENGTH = 20.0
#: Accepted from this posterior.
CONFIDENT = 0.5
UNKNOWN = "und"
#: Likelihoods of words that are remembered, and that are worked out at once with their n-grams.
CACHE_CELLS, LEARN_CELLS = 750_000, 40_000
HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


class TextModel:
    """Log likelihoods of texts under each language, the flat model last."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        self._place: dict[str, int] = {}
        self._rows = np.zeros((0, table.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        plain = [folded(w) for w in words]
        lettered = np.array([any(c.isalpha() for c in w) for w in plain])
        bucket, counts = grams(plain, BUCKETS, GRAMS)
        value = np.add.reduceat(self.table[bucket], np.cumsum(counts) - counts) / counts[:, None]
        value[~lettered] = 0
        self._place.update(zip(words, range(len(self._rows), len(self._rows) + len(words)), strict=True))
        self._rows = np.concatenate([self._rows, value.astype(np.float32)])

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        if self._rows.size > CACHE_CELLS:
            self._place.clear()
            self._rows = self._rows[:0]
        missing = list({w for words in split for w in words if w not in self._place})
        at_once = max(1, LEARN_CELLS // self.table.shape[1])
        for k in range(0, len(missing), at_once):
            self._learn(missing[k : k + at_once])
        get = self._place.__getitem__
        return np.stack([self._rows[np.fromiter(map(get, words), np.int64, len(words))].sum(0, dtype=float) if words else np.zeros(self.table.shape[1]) for words in split])


def train(samples: Iterable[tuple[str, str]], names: list[str]) -> TextModel:
    """n-gram models of the languages ``names`` from (text, language)."""
    place = {name: i for i, name in enumerate(names)}
    table = np.full((BUCKETS, len(names) + 1), SMOOTHING)
    for text, language in samples:
        words = [w for w in map(folded, text.split()) if any(c.isalpha() for c in w)]
        if words:
            table[:, place[language]] += np.bincount(grams(words, BUCKETS, GRAMS)[0], minlength=BUCKETS)
    table /= table.sum(0)
    return TextModel(names, np.log(table, out=table).astype(np.float32))


def learn(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> TextModel:
    """A model of every language that labels rows, from at most ``sample`` rows of each, those with the least hash of their key, while they have under ``chars`` characters."""
    rows = labelled.select(quoted(key).alias("k"), F.lower(quoted(language).cast("string")).alias("l"), quoted(text).cast("string").alias("t")).filter("l IS NOT NULL AND l <> '' AND t IS NOT NULL")
    names = sorted(r["l"] for r in rows.filter("k IS NOT NULL").select("l").distinct().collect())
    keys = written(sampled(rows, "l", sample)) if names else None

    def samples() -> Iterator[tuple[str, str]]:
        for i in range(0, len(names), TOGETHER):  # keys first, so that no task gathers texts
            own = rows.join(F.broadcast(keys.filter(F.col("l").isin(names[i : i + TOGETHER]))), ["k", "l"])
            before = F.sum(F.length("t")).over(W.partitionBy("l").orderBy(F.xxhash64("k"), "k", "t").rowsBetween(W.unboundedPreceding, -1))
            own = own.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < chars).orderBy(F.xxhash64("k"), "k", "t").toPandas()
            yield from zip(own["t"], own["l"], strict=True)

    return train(samples(), names)


def declared_in(html: Column) -> Column:
    """The primary language that markup declares, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1))
    return F.when(found != "", found)


def host_in(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """The last label of a host name."""
    found = F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)$", 1)
    return F.when(found != "", found)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    found = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(found != "", found)


def identify(
    df: DataFrame,
    model: TextModel,
    text: str = "text",
    markup: bool = False,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Adds ``language``, ``confidence`` and ``accepted`` to each row.

    ``declared``, ``suffix``, ``host`` and ``domain`` are expressions on the
    rows; one that is missing or null is no evidence (a null host takes the
    table's prior).  ``markup``: the text is HTML, of which only what a reader
    sees counts.  A null text, or one without letters, has no language and is
    ``und``, not accepted, whatever else is declared; so is one that the flat
    model explains best.  Repeated rows are judged each, very long texts whole;
    input columns named like an output are replaced; an empty table stays empty.
    """
    outputs = ("language", "confidence", "accepted")
    carry = with_replaced(df, *outputs) if carry is None else [c for c in carry if c.lower() not in outputs]
    names = [*model.languages, UNKNOWN]
    none = F.lit(None).cast("string")
    evidence = {"__declared": declared, "__suffix": suffix, "__host": host, "__domain": domain}
    carried = F.struct(*[quoted(c) for c in carry]) if carry else F.struct(none.alias("none"))  # apart from the names used here
    source = df.select(carried.alias("__row"), quoted(text).cast("string").alias("__text"), *[(none if e is None else e.cast("string")).alias(n) for n, e in evidence.items()])
    kept = [f for f in source.schema.fields if f.name != "__text"]
    schema = T.StructType([*kept, T.StructField("__text_ll", T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.table))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = TextModel(*shared.value)
        for batch in batches:
            for part, texts in text_slices(batch, "__text"):
                if markup:
                    texts = [HIDDEN.sub(" ", t) for t in texts]
                value = _MODELS[name].likelihoods(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(list(value))], names=[f.name for f in schema.fields])

    rows = written(source.mapInArrow(run, schema)).withColumn("__blank", F.forall("__text_ll", lambda x: x == 0))
    own_best = F.array_position("__text_ll", F.array_max("__text_ll")).cast("int") - 1
    guessed = rows.filter(~F.col("__blank")).withColumn("__l", own_best)
    k = len(names)

    def table_of(by: list[str]) -> DataFrame:
        """For each value the count of texts in each language."""
        return guessed.groupBy(*by).agg(F.array(*[F.count_if(F.col("__l") == i) for i in range(k)]).alias("n"))

    overall = (guessed.agg(*[F.count_if(F.col("__l") == i).alias(f"n{i}") for i in range(k)]).first() or [0] * k)
    total = [float(x or 0) for x in overall]
    share = [(x + 1) / (sum(total) + k) for x in total]
    flat = F.array(*[F.lit(s) for s in share])

    def smoothed(n: Column, above: Column) -> Column:
        size = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(n, above, lambda x, p: (x + HOST_STRENGTH * p) / (size + HOST_STRENGTH))

    def likelihood(n: Column) -> Column:
        """log P(value | language) for the counts of one value."""
        return F.zip_with(n, F.array(*[F.lit(t) for t in total]), lambda x, t: F.log((x + EVIDENCE_STRENGTH / k) / (t + EVIDENCE_STRENGTH)))

    hosts = table_of(["__host", "__domain"]).filter("__host IS NOT NULL").groupBy("__host").agg(F.max("__domain").alias("__domain"), F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(k)]).alias("n"))
    domains = table_of(["__domain"]).filter("__domain IS NOT NULL").withColumn("p_domain", smoothed(F.col("n"), flat)).select("__domain", "p_domain")
    prior = hosts.join(domains, "__domain", "left").select("__host", F.transform(smoothed(F.col("n"), F.coalesce("p_domain", flat)), lambda p: F.log(p)).alias("__prior"))
    apart = F.concat(F.lit("\0"), F.monotonically_increasing_id())  # no rows meet for want of a host
    joined = rows.withColumn("__host", F.coalesce("__host", apart)).join(few_or_shuffled(written(prior), F.lit(8 * k)), "__host", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    for column in ("__declared", "__suffix"):
        seen = table_of([column]).filter(F.col(column).isNotNull()).select(column, likelihood(F.col("n")).alias(f"{column}_ll"))
        joined = joined.join(few_or_shuffled(written(seen), F.lit(8 * k)), column, "left")
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    log_flat = F.array(*[F.lit(float(np.log(s))) for s in share])
    score = added(added(F.col("__text_ll"), F.coalesce("__prior", log_flat)), added(F.coalesce("__declared_ll", zero), F.coalesce("__suffix_ll", zero)))
    fused = joined.withColumn("__score", score).withColumn("__top", F.array_max("__score"))
    weight = F.aggregate("__score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))
    fused = fused.withColumn("__p", 1 / weight).withColumn("__best", F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("__score", F.col("__top")).cast("int")))
    language = F.when(F.col("__blank"), F.lit(UNKNOWN)).otherwise(F.col("__best"))
    confidence = F.when(F.col("__blank"), F.lit(0.0)).otherwise(F.col("__p"))
    return fused.select(*[F.col("__row").getField(c).alias(c) for c in carry], language.alias("language"), confidence.alias("confidence"), ((language != UNKNOWN) & (confidence >= CONFIDENT)).alias("accepted"))


_MODELS: dict[str, TextModel] = {}
