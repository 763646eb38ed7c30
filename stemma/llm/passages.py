"""Removal of passages that repeat across documents, by content-cut units and paragraph MinHash banding.

Texts are cut into units of some words at line ends and, inside lines, before
words whose hash is the least among their neighbours', so that cuts depend on
nearby words only.  A passage that two documents share is so cut alike in both,
wherever it stands, also in the middle of sentences.

A unit that an earlier document has is a repeat.  How far the passage goes beyond
its whole units is told by the words around that unit in earlier documents: in the
earliest one that has it and in those that hold the rest of the passage, wherever
it stands there.  As both texts are cut alike up to a few words before a passage
ends, its rest is never longer than the earlier document's next unit and MARGIN.

Lines are paragraphs, banded by MinHash of their word shingles, with bands tuned
for recall at the threshold; classes that collide are joined, exact Jaccard
similarity decides, and connected components of similar classes stand for one
passage.  Passages stay in the document with the least key and go from the
others, where they have at least MIN_RUN words.  A paragraph goes only if it is
itself similar to one of an earlier document, not by a chain of similar ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.components import components
from stemma.llm.encoding import text_slices
from stemma.llm.shared import KEY_BYTES, few, few_or_shuffled, quoted, unused, with_replaced, with_wide, written
from stemma.llm.tiles import merged_groups

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.98
#: A unit begins at a word whose hash is the least within so many words on both sides; words after which any word begins one.
NEAR, MOST_WORDS = 4, 512
#: Words of a line that is a paragraph: of fewer words only equal lines are similar enough.
PARAGRAPH = 13
#: Words before and after a unit that are told of an earlier document at least, and words beyond the next unit in which cuts depend on what follows a passage.
AROUND, MARGIN = 24, 2 * NEAR + 2
#: Words that must agree beyond the end of a line; fewer are a coincidence.
BY_CHANCE = 3
#: Words of a passage that is removed, and words between repeated ones that count as part of it.
MIN_RUN, BRIDGE = 50, 2
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 8) -> tuple[int, int]:
    """Bands and rows of each: the most rows for which no more than ``most`` bands reach the recall at the similarity."""
    best = (1, 1)
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands <= most:
            best = (bands, rows)
    return best


BANDS, ROWS = tune_bands(most=6)
#: MinHashes of a paragraph that screen pairs, and the share that must agree: 3.5 standard deviations under the similarity.
SCREENED, SCREEN = 64, 0.62
#: Classes that are compared without a screen.
FEW = 16


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """64-bit hashes of words without marks and case, remembered between texts."""

    def __init__(self, most: int = 200_000):
        self.place: dict[str, int] = {}
        self.table = np.zeros(0, np.uint64)
        self.most = most

    def hashes(self, words: list[str]) -> np.ndarray:
        place = self.place
        if len(place) > self.most:
            place.clear()
            self.table = self.table[:0]
        missing = list({w for w in words if w not in place})
        if missing:
            place.update(zip(missing, range(len(self.table), len(self.table) + len(missing)), strict=True))
            own = np.fromiter((xxhash.xxh64_intdigest(w.lower().strip(".,;:!?\"'()[]")) for w in missing), np.uint64, len(missing))
            self.table = np.concatenate([self.table, own])
        return self.table[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]


_WORDS = Words()


def paragraphs(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, their hashes, the first word of each unit, and the first unit of each text and beyond."""
    words, hashes, first, starts, _ = units_and_lines(texts)
    return words, hashes, first, starts


def units_and_lines(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``paragraphs`` gives, and the first word of each line."""
    words, line_starts, text_starts = [], [], []
    for text in texts:
        text_starts.append(len(words))
        for line in text.split("\n"):
            if own := line.split():
                line_starts.append(len(words))
                words += own
    text_starts.append(len(words))
    hashes, lines = _WORDS.hashes(words), np.array(line_starts, np.int64)
    if not words:
        return words, hashes, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), lines
    n, size = len(words), np.diff([*line_starts, len(words)])
    with np.errstate(over="ignore"):
        pair = mixed(hashes + np.roll(hashes, -1) * MULTIPLIER)
    place = np.arange(n) - np.repeat(lines, size)
    cut = (place >= NEAR) & (np.repeat(size, size) - place > NEAR + 1)
    for k in range(1, NEAR + 1):
        cut[k:] &= pair[k:] < pair[:-k]
        cut[:-k] &= pair[:-k] <= pair[k:]
    cut[lines] = True
    first = np.flatnonzero(cut)
    long = np.diff([*first, n])
    if long.max() > MOST_WORDS:
        first = np.concatenate([np.arange(a, a + m, MOST_WORDS) for a, m in zip(first.tolist(), long.tolist(), strict=True)])
    return words, hashes, first, np.searchsorted(first, text_starts), lines


def line_digests(hashes: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of lines, apart from those of units, and which lines are paragraphs."""
    return mixed(sentence_grain(hashes, lines) ^ MULTIPLIER), np.diff([*lines, len(hashes)]) >= PARAGRAPH


def word_spans(text: str, words: list[str]) -> tuple[list[int], list[int]]:
    """Where each word starts and ends in the text."""
    starts, ends, at = [], [], 0
    for w in words:
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    return starts, ends


def sentence_grain(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the words of each paragraph, in order."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = np.diff([*first, len(hashes)])
    place = (np.arange(len(hashes)) - np.repeat(first, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(mixed(hashes + (place + np.uint64(1)) * MULTIPLIER), first) + size.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles inside each paragraph (a shorter paragraph is one), and where each paragraph's begin."""
    size = np.diff([*first, len(hashes)])
    counts = np.maximum(size - SHINGLE + 1, 1)
    begin = np.cumsum(counts) - counts
    at = np.repeat(first - begin, counts) + np.arange(counts.sum())
    end = np.repeat(first + size, counts)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            inside = at + k < end
            word = np.where(inside, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0))
            out = out * np.uint64(1_000_003) + word
    return mixed(out), begin


def bands(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Keys of each paragraph's bands, as (paragraphs, BANDS)."""
    keys = np.zeros((len(begin), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            for r in range(ROWS):
                salt = mixed(np.array([b * ROWS + r + 1], np.uint64) * MULTIPLIER)[0]
                least = np.minimum.reduceat((shingles ^ salt) * MULTIPLIER ^ (shingles >> np.uint64(17)) * (salt | np.uint64(1)), begin)
                keys[:, b] = keys[:, b] * np.uint64(1_000_003) + mixed(least)
            keys[:, b] = mixed(keys[:, b] + np.uint64(b))
    return keys


def _units(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each unit and each paragraph of a document: ``doc_id``, ``digest``, and ``k0`` to ``k5``, the keys of a paragraph's bands.

    ``at`` and ``upto`` are the first and last of its units, counted in the text;
    ``words`` its words, ``before`` and ``after`` those of the units next to it.
    """
    source = df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text"))
    places = ["at", "upto", "words", "before", "after"]
    schema = T.StructType([source.schema["doc_id"], T.StructField("digest", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in places], *[T.StructField(f"k{b}", T.LongType()) for b in range(BANDS)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                _, hashes, first, starts, lines = units_and_lines(texts)
                if not len(first):
                    continue
                owner, size = np.repeat(np.arange(len(texts)), np.diff(starts)), np.diff([*first, len(hashes)])

                def rows(digest: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray, keys: list) -> pa.RecordBatch:
                    own = owner[low]
                    before = np.where(low > starts[own], size[low - 1], 0)
                    after = np.where(high + 1 < starts[own + 1], size[np.minimum(high + 1, len(size) - 1)], 0)
                    numbers = [pa.array(x, pa.int32()) for x in (low - starts[own], high - starts[own], words, before, after)]
                    return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own)), pa.array(digest.view(np.int64)), *numbers, *keys], names=schema.names)

                every = np.arange(len(first))
                yield rows(sentence_grain(hashes, first), every, every, size, [pa.nulls(len(first), pa.int64())] * BANDS)
                digest, enough = line_digests(hashes, lines)
                keys = bands(*shingle_hashes(hashes, lines)).view(np.int64)[enough]
                low = np.searchsorted(first, lines)
                high = np.append(low[1:], len(first)) - 1
                yield rows(digest[enough], low[enough], high[enough], np.diff([*lines, len(hashes)])[enough], [pa.array(np.ascontiguousarray(keys[:, b])) for b in range(BANDS)])

    return source.mapInArrow(run, schema)


def _surroundings(wanted: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(``digest``, ``keeper``, ``around``): for each place of a unit in the document ``keeper`` the word hashes before, backwards, and after it; places with equal ones count once."""
    asked = written(wanted.groupBy(F.col("keeper").alias("doc_id")).agg(F.collect_set("digest").alias("digests")))
    texts = with_wide(df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text")), asked, "doc_id", 8 * F.size("digests"))
    place = "struct<before:binary,after:binary>"
    names = T.StructType([T.StructField("keeper", texts.schema["doc_id"].dataType)]).simpleString()[len("struct<") : -1].replace(":", " ")
    arrow = pa.struct([("before", pa.binary()), ("after", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants, at = batch.column("digests"), 0
            for part, own in text_slices(batch, "text"):
                _, hashes, first, starts = paragraphs(own)
                if len(first):
                    every, edges, small = sentence_grain(hashes, first).view(np.int64), np.append(first, len(hashes)), shortened(hashes)
                    owner, digests, places = [], [], []
                    for i in range(len(own)):
                        a, b = starts[i], starts[i + 1]
                        want, seen = set(wants[at + i].as_py()), set()
                        for u, d in enumerate(every[a:b].tolist(), a):
                            if d in want:
                                x, y = edges[u], edges[u + 1]
                                back = max(edges[a], min(x - AROUND, edges[max(u - 1, a)] - MARGIN))
                                on = min(edges[b], max(y + AROUND, edges[min(u + 2, b)] + MARGIN))
                                seen.add((d, small[back:x][::-1].tobytes(), small[y:on].tobytes()))
                        owner += [i] * len(seen)
                        digests += [d for d, _, _ in seen]
                        places += [{"before": before, "after": after} for _, before, after in seen]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(places, arrow)], names=["digest", "keeper", "place"])
                at += len(own)

    return texts.mapInArrow(cut, f"digest long, {names}, place {place}").groupBy("digest", "keeper").agg(F.collect_set("place").alias("around"))


def shortened(hashes: np.ndarray) -> np.ndarray:
    """16 bits of word hashes, never 0."""
    return (hashes >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def _sets(colliding: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(``digest``, ``shingles``) of the classes in ``colliding``: (``digest``, ``doc_id``); only the documents named are read again."""
    wanted = written(colliding.groupBy("doc_id").agg(F.collect_set("digest").alias("digests")))
    texts = with_wide(df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text")), wanted, "doc_id", 8 * F.size("digests"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants = batch.column("digests")
            at = 0
            for part, own in text_slices(batch, "text"):
                digests, sets = [], []
                _, hashes, units, starts, first = units_and_lines(own)
                if len(first):
                    shingles, begin = shingle_hashes(hashes, first)
                    ends, every = [*begin[1:].tolist(), len(shingles)], line_digests(hashes, first)[0].view(np.int64).tolist()
                    starts = np.searchsorted(first, np.append(units, len(hashes))[starts])
                    for i in range(len(own)):
                        want = set(wants[at + i].as_py())
                        for u in range(starts[i], starts[i + 1]):
                            if every[u] in want:
                                want.discard(every[u])
                                digests.append(every[u])
                                sets.append(np.unique(shingles[begin[u] : ends[u]]).view(np.int64))
                at += len(own)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])

    return written(texts.mapInArrow(cut, "digest long, shingles array<long>").groupBy("digest").agg(F.first("shingles").alias("shingles")))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of classes with Jaccard similarity of at least SIMILARITY."""
    both = F.size(F.array_intersect("x", "y"))
    held = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y")), "b")
    return held.filter(both >= SIMILARITY * (F.size("x") + F.size("y") - both)).select("a", "b")


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low bytes of SCREENED MinHashes of a set."""
    h = shingles.view(np.uint64)
    least = np.full(SCREENED, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, ((h[k : k + 4096] ^ _SALT) * _FACTOR).min(1))
    return mixed(least).astype(np.uint8)


_SALT, _FACTOR = mixed(np.arange(1, 2 * SCREENED + 1, dtype=np.uint64) * MULTIPLIER).reshape(2, SCREENED, 1) | np.uint64(1)


def _prepared(pdf: pd.DataFrame):
    """Comparison of a task's classes."""
    sets = [np.asarray(s, np.int64) for s in pdf["shingles"]]
    size = np.array([len(s) for s in sets])
    signs = np.stack([signature(s) for s in sets]) if len(sets) > FEW else None

    def screened(i: int, other: np.ndarray) -> np.ndarray:
        other = other[(size[other] >= SIMILARITY * size[i]) & (size[i] >= SIMILARITY * size[other])]
        return other if signs is None else other[(signs[other] == signs[i]).mean(1) >= SCREEN]

    def same(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both >= SIMILARITY * (size[i] + size[j] - both)

    return screened, same


def _keepers(colliding: DataFrame, classes: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """(``digest``, ``keeper``): for each class that is similar to others the earliest document that has it or one similar to it.

    ``colliding``: (``band``, ``digest``, ``doc_id``), a document for each class, its
    earliest.  The classes of a band key are compared with the one of the earliest
    document, and what this leaves in different groups with each other, tile by tile.
    Each class of a component is then compared with that of its earliest document.
    """
    sets = _sets(colliding.select("digest", "doc_id").distinct(), df, key, text)
    heads = colliding.groupBy("band").agg(F.min_by("digest", F.struct("doc_id", "digest")).alias("b"))
    stars = written(_similar(colliding.join(heads, "band").filter("digest <> b").select(F.col("digest").alias("a"), "b").distinct(), sets))
    labels = components(stars).select(F.col("node").alias("uid"), F.col("component").alias("group"))
    sized = written(sets.select(F.col("digest").alias("uid"), F.size("shingles").cast("long").alias("size")).join(few_or_shuffled(labels), "uid", "left").withColumn("group", F.coalesce("group", "uid")))
    known = colliding.select("band", F.col("digest").alias("uid")).join(sized, "uid")
    merged = components(written(merged_groups(known, sets.withColumnRenamed("digest", "uid"), _prepared))).withColumnRenamed("node", "group")
    grouped = sized.join(few_or_shuffled(merged), "group", "left").select(F.col("uid").alias("digest"), F.coalesce("component", "group").alias("component"))
    least = classes.select("digest", "least")
    grouped = written(grouped.join(least, "digest"))
    first = grouped.groupBy("component").agg(F.min_by("digest", F.struct("least", "digest")).alias("b"))
    tried = grouped.join(first, "component").filter("digest <> b").select(F.col("digest").alias("a"), "b").join(stars, ["a", "b"], "left_anti")
    links = _similar(tried, sets).unionByName(stars)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(least.withColumnRenamed("digest", "b"), "b").groupBy(F.col("a").alias("digest")).agg(F.min("least").alias("keeper"))


def _passages(hits: DataFrame) -> DataFrame:
    """Those of ``hits``, units and paragraphs that an earlier document has, which may be part of a passage of MIN_RUN words.

    Hits follow each other in a passage if one unit at most lies between them; such
    a unit, and those next to a passage, may belong to it in part, and some words
    beyond those, where what follows the passage makes a cut in its last words.  ``edge``: units
    at an end or a gap, from where the passage may go on.  ``keepers``: earlier
    documents that may hold the passage there: the unit's, those of the hits next to
    it, and the last one of the passage, as units that stand elsewhere too have earlier ones.
    """
    order = W.partitionBy("doc_id").orderBy("at", "upto")
    before, upto_here = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    placed = hits.withColumn("reach", F.max("upto").over(before)).withColumn("reached", F.max("upto").over(upto_here)).withColumn("next", F.lead("at").over(order))
    left = F.col("reach").isNull() | (F.col("at") > F.col("reach") + 1)
    right = F.col("next").isNull() | (F.col("next") > F.col("reached") + 1)
    begins = F.col("reach").isNull() | (F.col("at") > F.col("reach") + 2)
    placed = placed.withColumn("beside", F.array(F.lag("keeper").over(order), F.lead("keeper").over(order)))
    placed = placed.withColumn("edge", F.col("unit") & (left | right)).withColumn("gap", F.when(left & ~begins, F.col("before")).otherwise(0)).withColumn("passage", F.sum(begins.cast("int")).over(upto_here))
    own = W.partitionBy("doc_id", "passage")
    ends = F.max(F.struct("upto", "after")).over(own)["after"] + F.min(F.struct("at", "before")).over(own)["before"]
    whole = F.sum(F.col("words") + F.col("gap")).over(own) + ends
    keepers = F.array_compact(F.array_distinct(F.concat(F.array("keeper", F.max("keeper").over(own)), "beside")))
    return placed.withColumn("whole", whole).withColumn("keepers", keepers).filter(F.col("whole") >= MIN_RUN - MARGIN).select("doc_id", "digest", "keepers", "edge")


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``found``): digests of units and paragraphs that an earlier document has, with what stands around a unit there."""
    units = written(_units(df, key, text))
    classes = units.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("k0").isNull().alias("unit"))
    classes = written(classes.filter("NOT unit OR least < most"))  # a unit of one document is of no use
    banded = units.filter("k0 IS NOT NULL").select("digest", "doc_id", F.explode(F.array(*[f"k{b}" for b in range(BANDS)])).alias("band")).groupBy("band", "digest").agg(F.min("doc_id").alias("doc_id"))
    within = W.partitionBy("band").orderBy("digest")
    colliding = written(banded.withColumn("more", F.lag("digest").over(within).isNotNull() | F.lead("digest").over(within).isNotNull()).filter("more").drop("more"))
    keepers = written(_keepers(colliding, classes, df, key, text))
    held = classes.join(keepers, "digest", "left").select("digest", F.least("least", "keeper").alias("keeper"), "most", "unit").filter("keeper < most").drop("most")
    hits = units.select("doc_id", "digest", "at", "upto", "words", "before", "after").join(held, "digest").filter(F.col("doc_id") > F.col("keeper"))
    wanted = written(_passages(hits))
    edges = written(wanted.filter("edge").select("doc_id", "digest", F.explode("keepers").alias("keeper")).distinct())
    around = written(_surroundings(edges.select("digest", "keeper").distinct(), df, key, text))
    found = edges.join(around, ["digest", "keeper"], "left").select("doc_id", "digest", "around").unionByName(wanted.filter("NOT edge").select("doc_id", "digest"), allowMissingColumns=True)
    once = found.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around"))
    return written(once.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "around")).alias("found")))


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed_words", spans: str = "removed_spans") -> DataFrame:
    """All rows with passages removed that an earlier document has.

    ``text`` is what remains, ``removed_words`` counts words removed and
    ``removed_spans`` gives [start, end) of each removed run in characters of
    the old text.  Repeats inside one document stay; so does a document whose
    key is null (it can't be earlier than another).  Rows that repeat with their
    key are one document, changed alike.  Null and empty texts stay as they are;
    very long texts are treated whole; input columns named like an output are
    replaced; an empty table stays empty.
    """
    bad = repeated(df, key, text)
    kept = with_replaced(df, removed, spans)
    at, held = unused(df, "__key"), unused(df, "__found")
    found = bad.select(F.col("doc_id").alias(at), F.col("found").alias(held))
    rows, same = df.select(*[quoted(c) for c in kept]), quoted(key) == F.col(at)
    apart = None
    if few(found, F.size(held) * 24 + F.aggregate(held, F.lit(0), lambda n, f: n + F.aggregate(f["around"], F.lit(0), lambda m, p: m + F.length(p["before"]) + F.length(p["after"])))):
        found = F.broadcast(found)
    elif few(found.select(at), row=KEY_BYTES):  # only documents that change are moved
        keys = F.broadcast(found.select(at))
        rows, apart = rows.join(keys, same, "left_semi"), rows.join(keys, same, "left_anti")
    rows = rows.join(found, same, "left").drop(at)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in rows.schema.fields if f.name != held]
    schema = T.StructType([*fields, T.StructField(removed, T.LongType()), T.StructField(spans, span)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, start = batch.column(held), 0
            for part, texts in text_slices(batch, text):
                own, gone, where = part.column(text).to_pylist(), [0] * len(texts), [[] for _ in texts]
                wanted = {i: {f["digest"]: f["around"] for f in d} for i in range(len(texts)) if (d := found[start + i].as_py())}
                for i, (cuts, words) in zip(wanted, without([texts[i] for i in wanted], list(wanted.values())), strict=True):
                    if cuts:
                        own[i], gone[i], where[i] = remaining(texts[i], cuts), words, [{"start": a, "end": b} for a, b in cuts]
                start += len(texts)
                arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [pa.array(own, pa.string()) if f.name == text else part.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64()), pa.array(where, arrow_span)], names=schema.names)

    changed = rows.mapInArrow(rewrite, schema)
    if apart is None:
        return changed
    of = {text: quoted(text).cast("string")}
    return changed.unionByName(apart.select(*[of.get(c, quoted(c)).alias(c) for c in kept], F.lit(0).cast("long").alias(removed), F.array().cast(span).alias(spans)))


def agreeing(own: np.ndarray, near: np.ndarray) -> int:
    """Words that agree from the first on."""
    n = min(len(own), len(near))
    return int(np.append(own[:n] == near[:n], False).argmin())


def without(texts: list[str], found: list[dict[int, list[dict[str, bytes]]]]) -> list[tuple[list[tuple[int, int]], int]]:
    """For each text the runs of words to remove as [start, end) in it, and the words in them."""
    words, hashes, first, starts, lines = units_and_lines(texts)
    every, whole = sentence_grain(hashes, first).view(np.int64).tolist(), line_digests(hashes, lines)[0].view(np.int64).tolist()
    edges, line_edges, small = [*first.tolist(), len(words)], [*lines.tolist(), len(words)], shortened(hashes)
    line_starts, line_at = np.searchsorted(lines, np.array(edges)[starts]).tolist(), set(line_edges)
    out = []
    for i, (text, want) in enumerate(zip(texts, found, strict=True)):
        a, b = starts[i], starts[i + 1]
        low, high = edges[a], edges[b]
        gone = np.zeros(high - low + 2, bool)  # a word more on both sides, which stays
        for u in range(line_starts[i], line_starts[i + 1]):
            if whole[u] in want:
                gone[line_edges[u] - low + 1 : line_edges[u + 1] - low + 1] = True
        held = [u for u in range(a, b) if every[u] in want]
        for u in held:
            gone[edges[u] - low + 1 : edges[u + 1] - low + 1] = True
        for u in held:  # on to the passage's ends
            if not (places := want[every[u]]):
                continue
            x, y = edges[u], edges[u + 1]
            back, on = 0, 0
            for p in places:  # the one that agrees in most words tells both ends
                before, after = np.frombuffer(p["before"], np.uint16), np.frombuffer(p["after"], np.uint16)
                m, n = agreeing(small[max(low, x - len(before)) : x][::-1], before), agreeing(small[y : min(high, y + len(after))], after)
                back, on = max((back, on), (m, n), key=sum)
            if x > low and not gone[x - low] and not (x in line_at and back < BY_CHANCE):
                gone[x - back - low + 1 : x - low + 1] = True
            if y < high and not gone[y - low + 1] and not (y in line_at and on < BY_CHANCE):
                gone[y - low + 1 : y + on - low + 1] = True
        change = np.flatnonzero(gone[1:] != gone[:-1])
        runs = []
        for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            if runs and x - runs[-1][1] <= BRIDGE:
                x = runs.pop()[0]
            runs.append((x, y))
        runs = [(x, y) for x, y in runs if y - x >= MIN_RUN]
        cuts = []
        if runs:
            begin, end = word_spans(text, words[low:high])
            cuts = [(begin[x], end[y - 1]) for x, y in runs]
        out.append((cuts, sum(y - x for x, y in runs)))
    return out


def remaining(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the runs; white space that a run leaves doubled shrinks to one side's."""
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    joined = out[0]
    for piece in out[1:]:
        if not joined or joined[-1].isspace():
            piece = piece.lstrip()
        joined += piece
    return joined.strip() if cuts else joined
