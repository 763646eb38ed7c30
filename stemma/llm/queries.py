"""The operators applied to the driver's tables, as registered in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import encoding, langid, lexical, lm, neighbours, packing, passages, periods, sharding, simhash, token_counts, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, under a model of those not held out; see ``toxicity.score`` for odd rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document, from a new cache; see ``token_counts.count_tokens`` for odd rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; see ``passages.remove_repeated`` for odd rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.remove_repeated(docs)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; see ``packing.pack`` for odd rows."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (by ``doc_id``) and pages (by ``page_id``), under models of the documents' languages.

    A document's declared language and host are its ``lang`` and ``source``.
    """
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = langid.learn(docs)
    host = langid.host_in(F.col("url"))
    of_docs = langid.identify(docs, model, declared=F.col("lang"), host=F.col("source"), carry=["doc_id"])
    of_pages = langid.identify(
        pages,
        model,
        text="html",
        markup=True,
        declared=langid.declared_in(F.col("html")),
        suffix=langid.suffix_of(host),
        host=host,
        domain=langid.domain_of(host),
        carry=["page_id"],
    )
    return of_docs.unionByName(of_pages, allowMissingColumns=True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to; see ``encoding.encode_decode`` for odd rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encoding.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id 50 divides the 5 of highest integer product; see ``topk.top_k`` for odd rows."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.integers(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of a label's near copies; see ``neighbours.near_duplicates`` for odd rows."""
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards of near-equal bytes; see ``sharding.shard`` for odd rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select(
        "doc_id",
        sharding.text_size(F.col("text")).alias("size"),
        sharding.crc32(F.col("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of documents; see ``simhash.near_duplicates`` for odd rows."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten is rewritten to repeat its words from some place on, as the contract of ``op11`` has it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))
    n = F.size("words").cast("long")
    split = docs.select("doc_id", "text", words.alias("words"), g.alias("g"))
    placed = split.withColumn("a", F.when(n > 0, (F.col("g") % n)).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    copies = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), copies))
    text = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), n.cast("int")), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's runs and of its text without repetitions, and its strongest run; see ``periods.periodic_runs`` for odd rows."""
    found = periods.periodic_runs(_with_repeats(_table(spark, sf_dir, "documents")), carry=["doc_id"])
    best = periods.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat_ws("\n", lines, F.when(F.size("runs") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return named.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the 10 documents of highest lexical score; see ``lexical.search`` for odd rows."""
    docs = _table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", "text")
    totals = lexical.statistics(docs)
    shards = lexical.stored(lexical.index(docs, totals=totals))
    return lexical.search(shards, _table(spark, sf_dir, "benchmark"), totals[0], k=10).withColumnRenamed("query_id", "item_id")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each document under a model of those not held out; see ``lm.language_model_scores`` for odd rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm.language_model_scores(docs.withColumn("held_out", held_out), ~F.col("held_out"), carry=["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_token_counts, op3_substring_dedup, op4_best_fit_packing, op5_language_id, op6_bpe, op7_top_k, op8_embedding_near_dedup, op9_sharding, op10_simhash_near_dedup, op11_periodic_runs, op12_ranked_search, op13_lm_scores]
    return {f.__name__: f for f in own}


#: Rows of ``embeddings`` whose vectors hold finite components only.
_VECTORS = "SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: CRC-32 of ``doc_id`` as text, by the table of its bytes' remainders.
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
 hashed AS (SELECT row_number() OVER () AS uid, doc_id, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc)"""

#: What a term is, for DuckDB; A-Z alone are lowered.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {
    "op12_ranked_search": f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS terms FROM documents WHERE doc_id IS NOT NULL),
 n AS (SELECT uid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0), a AS (SELECT count(*) AS texts, sum(n)::BIGINT AS all_terms FROM n),
 p AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM d) GROUP BY 1, 2),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(texts) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term),
 q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1)),
 s AS (SELECT item_id, uid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // all_terms))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (uid), a GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op11_periodic_runs": rf"""WITH {_CRC},
 split AS (SELECT *, h // 10 AS g, len(words) AS n FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM hashed)),
 placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM split),
 d AS (SELECT uid, doc_id, n, list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS words FROM placed),
 w AS MATERIALIZED (SELECT uid, n, unnest(range(n)) AS i, unnest(words) AS w FROM d),
 e AS (SELECT x.uid, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.uid = y.uid AND x.w = y.w AND y.i > x.i WHERE (y.i - x.i) * 4 <= x.n),
 s AS (SELECT uid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY uid, q ORDER BY i) AS island FROM e) GROUP BY uid, q, island),
 r AS MATERIALIZED (SELECT uid, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY uid, start, length),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r) WHERE place = 1),
 t AS (SELECT uid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY uid),
 gone AS (SELECT DISTINCT uid, unnest(range(start + period, start + length)) AS i FROM r),
 c AS (SELECT uid, string_agg(w, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (uid, i) GROUP BY uid)
 SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
 FROM d LEFT JOIN t USING (uid) LEFT JOIN b USING (uid) LEFT JOIN c USING (uid)""",
    "op7_top_k": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM ({_VECTORS})),
 q AS (SELECT vec_id AS query_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY 1),
 s AS (SELECT query_id, vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score FROM q JOIN v ON vec_id <> query_id AND len(q.v) = len(v.v)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM ({_VECTORS}) WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 e AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.label = b.label AND a.i <> b.i AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98),
 reach AS (SELECT i AS a, i AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
 least AS (SELECT reach.a AS i, min(vec_id) AS component_id FROM reach JOIN v ON reach.b = v.i GROUP BY 1), n AS (SELECT a AS i, count(*) AS n FROM e GROUP BY 1)
 SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least USING (i) LEFT JOIN n USING (i)
 UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM v)""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can state on whole tables; the others are tested against brute force."""
    return dict(SQL)
