"""SimHash near-duplicates by the general pigeonhole principle.

Bits of the fingerprints are grouped into parts, correlated bits together.  For
a threshold t and m parts, any allocation of thresholds to parts with the sum
t - m + 1 finds every pair within t in some part (-1 leaves a part out).  For
each fingerprint a dynamic programme picks the allocation with the least
estimated candidates: the count of its own value for threshold 0, and for 1 the
counts expected at the neighbouring values under the parts' bit rates.  It then
probes the values within each part's threshold, and candidates are verified.

A value shared by more than HEAVY fingerprints is not paired up.  Its members,
and probes that reach it, are keyed by the remaining bits and by those with one
bit flipped; fingerprints under one key are within the threshold of 2 of each
other, so linking each to the least of its key loses no connection and makes no
more rows than fingerprints times bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.components import components
from stemma.llm.encoding import text_slices
from stemma.llm.shared import few_or_shuffled, quoted, written
from stemma.llm.tiles import merged_groups

BITS = 64
THRESHOLD = 2
PARTS = 3
HEAVY = 32
#: Candidates that a probe costs as much as.
PROBE_COST = 0.2
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of 64-bit hashes have each bit, lowest first; bytes of a word are counted side by side."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[: len(hashes)] = hashes
    padded = padded.reshape(-1, 255)
    counts = np.zeros(64, np.int64)
    for j in range(8):
        lanes = ((padded >> np.uint64(j)) & LANES).sum(1)
        counts[j::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included (no words: 0)."""
    own = text.encode().translate(LOWER).split()
    if not own:
        return 0
    shingles = map(b" ".join, zip(*[own[i:] for i in range(words)])) if len(own) >= words else [b" ".join(own)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    return int.from_bytes(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(``doc_id``, ``fp``): the fingerprint as a signed 64-bit integer."""
    source = df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                own = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own)], names=["doc_id", "fp"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())]))


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, rate of each bit, and correlations of bits, from all fingerprints."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in batches:
            b = bits_of(pdf["fp"].to_numpy()).astype(float)
            n, both = n + len(b), both + b.T @ b
        i, j = np.triu_indices(BITS)
        yield pd.DataFrame({"i": [-1, *i], "j": [-1, *j], "s": [float(n), *both[i, j]]})

    total = distinct.select("fp").mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in total:
        if r["i"] < 0:
            n = int(r["s"])
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["s"]
    both /= max(n, 1)
    rate = np.diag(both).copy()
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    return n, rate, (both - np.outer(rate, rate)) / np.outer(spread, spread)


def partition_bits(correlation: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Parts of near-equal width: each grows from a free bit by the bit most correlated with those it has."""
    free, strength, out = set(range(len(correlation))), np.abs(correlation), []
    for k in range(parts):
        width = len(free) // (parts - k)
        seed = max(free, key=lambda b: (strength[b, list(free)].sum(), -b))
        own = [seed]
        free.discard(seed)
        while len(own) < width:
            b = max(free, key=lambda x: (strength[x, own].sum(), -x))
            own.append(b)
            free.discard(b)
        out.append(sorted(own))
    return out


def part_values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    """A part's bits, packed."""
    value = np.zeros(len(fp), np.int64)
    for place, bit in enumerate(part):
        value |= ((fp >> bit) & 1) << place
    return value


def allocations(cost: np.ndarray, total: int) -> np.ndarray:
    """Thresholds from -1 of least total cost with a given sum.

    ``cost[r, i, t + 1]``: of threshold t in part i for row r.  Returns (rows, parts).
    """
    rows, parts, options = cost.shape
    span = parts * (options - 1) + 1
    best = np.full((rows, span), np.inf)
    best[:, 0] = 0
    picks = []
    for i in range(parts):
        after, pick = np.full((rows, span), np.inf), np.zeros((rows, span), np.int64)
        for o in range(options):
            moved = np.full((rows, span), np.inf)
            moved[:, o:] = best[:, : span - o] + cost[:, i, o : o + 1]
            pick[moved < after] = o
            after = np.minimum(after, moved)
        best = after
        picks.append(pick)
    at, out = np.full(rows, total + parts), np.zeros((rows, parts), np.int64)
    for i in reversed(range(parts)):
        out[:, i] = picks[i][np.arange(rows), at]
        at = at - out[:, i]
    return out - 1


def links(distinct: DataFrame, parts: int = PARTS, threshold: int = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints ``fp`` whose components are those of all pairs within 2 bits."""
    if threshold != 2:
        raise ValueError("the keys for heavy values hold for a threshold of 2")
    n, rate, correlation = bit_statistics(distinct)
    groups = partition_bits(correlation, parts)
    masks = [sum(1 << b for b in g) for g in groups]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for i, g in enumerate(groups):
                yield pd.DataFrame({"part": np.int32(i), "value": part_values(fp, g), "fp": fp})

    values = written(distinct.select("fp").mapInPandas(index, "part int, value long, fp long"))
    counts = values.groupBy("part", "value").agg(F.count("*").alias("n"))
    sized = values.join(counts, ["part", "value"])
    per_fp = sized.groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)])

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each fingerprint the values to probe, and how far each is from its own."""
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            cost = np.zeros((len(fp), parts, 3))
            b = bits_of(fp)
            p_own = np.where(b == 1, rate, 1 - rate).clip(1e-6, 1 - 1e-6)
            for i, g in enumerate(groups):
                own = pdf[f"n{i}"].to_numpy(float)
                near = n * np.exp(np.log(p_own[:, g]).sum(1)) * ((1 - p_own[:, g]) / p_own[:, g]).sum(1)
                cost[:, i, 1] = own + PROBE_COST
                cost[:, i, 2] = own + near + PROBE_COST * (1 + len(g))
            chosen = allocations(cost, threshold - parts + 1)
            for i, g in enumerate(groups):
                at = chosen[:, i] >= 0
                value = part_values(fp[at], g)
                yield pd.DataFrame({"part": np.int32(i), "value": value, "far": np.int32(0), "q": fp[at]})
                at = chosen[:, i] >= 1
                value = part_values(fp[at], g)
                for place in range(len(g)):
                    yield pd.DataFrame({"part": np.int32(i), "value": value ^ (1 << place), "far": np.int32(1), "q": fp[at]})

    asked = written(per_fp.mapInPandas(probes, "part int, value long, far int, q long"))
    light = values.join(counts.filter((F.col("n") <= heavy)), ["part", "value"])
    pairs = light.join(asked, ["part", "value"]).filter((F.col("q") != F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= threshold))
    near = pairs.select(F.col("q").alias("a"), F.col("fp").alias("b"))

    crowded = counts.filter(F.col("n") > heavy).select("part", "value")
    rest = F.lit(None).cast("long")
    for i, m in enumerate(masks):
        rest = F.when(F.col("part") == i, F.col("fp").bitwiseAND(F.lit(signed(~m & (1 << 64) - 1)))).otherwise(rest)
    flips = F.lit(None).cast("array<long>")
    for i, g in enumerate(groups):
        others = [b for b in range(BITS) if b not in g]
        flips = F.when(F.col("part") == i, F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)).cast("long") for b in others])).otherwise(flips)
    members = values.join(crowded, ["part", "value"]).select("part", "value", "fp", rest.alias("rest"), F.explode(flips).alias("flip"))
    members = members.select("part", "value", F.col("rest").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    visits = asked.filter("far = 1").join(crowded, ["part", "value"]).select("part", "value", F.col("q").alias("fp"))
    visits = visits.select("part", "value", rest.alias("key"), "fp")
    keyed = members.unionByName(visits)
    heads = keyed.groupBy("part", "value", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = keyed.join(heads, ["part", "value", "key"]).filter("fp <> a").select("a", F.col("fp").alias("b"))
    return written(near.unionByName(stars.distinct()))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``) for every row.

    The component is that of fingerprints linked at 2 or fewer differing bits,
    named by its smallest key.  A null, empty or blank text has fingerprint 0,
    linked like any other; rows with equal texts, repeated rows included, share
    a fingerprint; a null key names no component; other columns are ignored; an
    empty table gives an empty result.
    """
    docs = written(fingerprints(df, key, text))
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct)).withColumnRenamed("node", "fp")
    named = written(distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "component").select("fp", "component_id")
    joined = docs.join(of, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies at a Jaccard similarity -------------------------------------
#
# SimHashes propose first: the fingerprints of all texts are linked as above, and a
# component of them is a value that its texts share.  But texts whose word shingles
# have Jaccard similarity 0.8 may differ in 15 % of the bits of a SimHash, too many
# for parts of its bits to meet.  So MinHashes propose the rest, as one agrees with
# the probability of the similarity itself, whatever the edits are and however large
# the corpus is: BANDS bands of ROWS are values as well.  Of the pairs under either
# kind of value the MinHashes' bytes screen those of different groups, and exact
# Jaccard similarity of the shingles decides.
#
# Groups are wanted, not pairs.  First each document is paired with one head: of
# the heads of its crowded values, the one its MinHashes are most like.  A
# value's head is the member that shares values with most others, so a text and
# its copies form a star around it.  Documents of a value that the stars leave in
# different groups are then compared in full, tile by tile, and pairs that are
# connected by then are passed over.  Links between groups alone leave a tile.

#: A pair at similarity 0.8 meets in some band with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.992.
BANDS, ROWS = 16, 6
#: Share of equal MinHashes from which a pair is looked at: 3.4 standard deviations under the similarity.
SCREEN = 0.66
SHINGLE = 5
SIMILARITY = 0.8
_SALT, _FACTOR = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)[:, :, None] * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (fewer words: the whole sequence)."""
    own = text.encode().translate(LOWER).split()
    shingles = map(b" ".join, zip(*[own[i:] for i in range(words)])) if len(own) >= words else [b" ".join(own)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(7)), np.uint64)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def min_hashes(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Values of the BANDS of a shingle set, and a byte of each MinHash."""
    h, least = shingles.view(np.uint64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, ((h[k : k + 4096] ^ _SALT) * _FACTOR).min(1))
    rows, value = _mixed(least).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        value = _mixed(value * np.uint64(1_000_003) + rows[:, r])
    return value.view(np.int64), (rows & np.uint64(255)).astype(np.uint8).tobytes()


def _prints(df: DataFrame) -> DataFrame:
    """(``uid``, ``digest``, ``fp``, ``size``, ``bands``, ``least``) of (``uid``, ``text``): digest of the words, SimHash, shingles, and ``min_hashes``."""
    schema = "uid long, digest binary, fp long, size long, bands array<long>, least binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                digests = [xxhash.xxh3_128_digest(b" ".join(t.encode().translate(LOWER).split())) for t in texts]
                sets = [shingle_set(t) for t in texts]
                bands, least = zip(*map(min_hashes, sets), strict=True) if sets else ((), ())
                own = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
                columns = [part.column("uid"), pa.array(digests, pa.binary()), pa.array(own), pa.array(map(len, sets), pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(least, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "digest", "fp", "size", "bands", "least"])

    return df.mapInArrow(run, schema)


def _shingled(df: DataFrame) -> DataFrame:
    """(``uid``, ``shingles``) of (``uid``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array([shingle_set(t) for t in own], pa.list_(pa.int64()))], names=["uid", "shingles"])

    return df.mapInArrow(run, "uid long, shingles array<long>")


def _unpacked(least: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(least), np.uint8).reshape(len(least), BANDS * ROWS)


def _stars(crowded: DataFrame, distinct: DataFrame, shingled: DataFrame) -> DataFrame:
    """Verified pairs (``a``, ``b``): of each ``uid`` and the head that it is most like."""
    crowd = crowded.groupBy("uid").agg(F.sum("n").alias("crowd"))
    heads = crowded.join(crowd, "uid").groupBy("band").agg(F.max_by("uid", F.struct("crowd", -F.col("uid"))).alias("head"))
    headed = written(crowded.join(heads, "band").filter("uid <> head").select("uid", "head").distinct())
    least = distinct.select("uid", "least")
    ends = headed.join(least.withColumnRenamed("least", "x"), "uid").join(least.select(F.col("uid").alias("head"), F.col("least").alias("y")), "head")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                share = (_unpacked(pdf["x"]) == _unpacked(pdf["y"])).mean(1)
                yield pdf[["uid", "head"]].assign(share=share)[share >= SCREEN]

    best = ends.mapInPandas(alike, "uid long, head long, share double").groupBy("uid").agg(F.max_by("head", F.struct("share", -F.col("head"))).alias("head"))
    both = F.size(F.array_intersect("x", "y"))
    pairs = written(best).join(shingled.withColumnRenamed("shingles", "x"), "uid").join(shingled.select(F.col("uid").alias("head"), F.col("shingles").alias("y")), "head")
    return written(pairs.filter(both >= SIMILARITY * (F.size("x") + F.size("y") - both)).select(F.col("uid").alias("a"), F.col("head").alias("b")))


def _merged(known: DataFrame, distinct: DataFrame, shingled: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of groups that hold near copies of each other; ``known``: (``band``, ``uid``, ``size``, ``group``)."""

    def prepared(pdf: pd.DataFrame) -> tuple[Callable, Callable]:
        sets, least, bands = pdf["shingles"].tolist(), _unpacked(pdf["least"]), np.stack(pdf["bands"].to_numpy())
        at = bands[0] == pdf["band"].iloc[0]
        place = int(at.argmax()) if at.any() else 0  # a value of SimHashes comes before all bands

        def screened(i: int, other: np.ndarray) -> np.ndarray:
            other = other[~(bands[other, :place] == bands[i, :place]).any(1)]  # else they meet under an earlier value
            return other[(least[other] == least[i]).mean(1) >= SCREEN]

        return screened, lambda i, j: jaccard(sets[i], sets[j]) >= SIMILARITY

    return written(merged_groups(known, distinct.select("uid", "bands", "least").join(shingled, "uid"), prepared))


def _groups(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(``uid``, ``component``) of those of ``distinct`` that are in a group of near copies with others."""
    linked = components(links(written(distinct.select("fp").distinct()))).withColumnRenamed("node", "fp")
    alike = distinct.select("uid", "size", "fp").join(few_or_shuffled(linked), "fp", "left").select("uid", "size", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("band"))
    values = written(distinct.select("uid", "size", F.explode("bands").alias("band")).unionByName(alike))
    crowds = values.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = written(values.join(crowds, "band"))
    shingled = written(_shingled(docs.join(few_or_shuffled(written(crowded.select("uid").distinct())), "uid", "left_semi")))
    labels = components(_stars(crowded, distinct, shingled)).select(F.col("node").alias("uid"), F.col("component").alias("group"))
    known = written(crowded.select("band", "uid", "size").join(few_or_shuffled(labels), "uid", "left").withColumn("group", F.coalesce("group", "uid")))
    merged = components(_merged(known, distinct, shingled)).withColumnRenamed("node", "group")
    grouped = known.select("uid", "group").distinct().join(few_or_shuffled(merged), "group", "left")
    return grouped.select("uid", F.coalesce("component", "group").alias("component"))


def without_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with one of each group of near copies: the one with the least key.

    Rows are near copies if their texts, lower-cased for A-Z, have Jaccard
    similarity of at least 0.8 on shingles of five words, or the same words; SimHashes
    within 2 bits and bands of MinHashes propose them;
    groups are their connected components.  Null, empty and blank texts are
    copies of each other.  Among rows with one key, repeated rows included, one
    stays; a null key comes after all others.  Columns and types stay as they
    are, an empty table stays empty, long texts are compared whole.
    """
    rows = written(df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    of_row = lambda name: F.col("row").getField(name)
    docs = rows.select("uid", of_row(text).cast("string").alias("text"))
    prints = written(_prints(docs))
    classes = prints.groupBy("digest").agg(F.min("uid").alias("uid"), *[F.first(c).alias(c) for c in ("fp", "size", "bands", "least")])
    distinct = written(classes)
    labels = _groups(distinct, docs)
    named = distinct.select("uid", "digest").join(labels, "uid", "left").select("digest", F.coalesce("component", "uid").alias("component"))
    member = prints.select("uid", "digest").join(named, "digest").select("uid", "component")
    keyed = rows.select("uid", of_row(key).alias("k")).join(member, "uid")
    first = keyed.groupBy("component").agg(F.min_by("uid", F.struct(F.col("k").isNull(), F.col("k"), F.col("uid"))).alias("uid"))
    gone = written(keyed.select("uid").join(first.select("uid"), "uid", "left_anti"))
    return rows.join(few_or_shuffled(gone), "uid", "left_anti").select("row.*")
