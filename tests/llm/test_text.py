"""Toxicity, language, repeated passages and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import langid, passages, toxicity
from stemma.llm.shared import written
from tests.llm.conftest import SCHEMA, prose


def toxic_rows(n, seed, spoil):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng.randint(20, 120), seed * 10_000 + i).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rng.randrange(len(words)), spoil(rng))
        rows.append((" ".join(words), int(bad)))
    return rows


def test_toxicity_generalises_to_misspellings():
    seen = lambda r: r.choice(["grumblefoot", "snotwaffle", "dungbrain", "grumblefoots", "snotwafle"])
    unseen = lambda r: r.choice(["grumblefeet", "snotwaffles", "dungbrains", "Grumblefoot!", "snotwaffel"])
    model = toxicity.train(*map(list, zip(*toxic_rows(900, 1, seen), strict=True)))
    held = toxic_rows(300, 2, unseen)
    predicted = np.array(model.scores([t for t, _ in held])) >= 0.5
    truth = np.array([y for _, y in held]) == 1
    assert predicted[truth].mean() > 0.75 and predicted[~truth].mean() < 0.1


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 0), (7, 1), (8, 0), (None, 1), (9, None), (7, 0), (2, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd_docs, labels)
    rows = toxicity.score(odd_docs.withColumn("Score", F.lit("x")), model).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.score(no_docs, model).count() == 0
    empty = toxicity.learn(odd_docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd_docs, empty).collect()} == {0}


def test_held_out_rows_are_never_learnt(spark, odd_docs):
    keys = odd_docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).filter("h").select("doc_id")
    only = keys.withColumn("toxic", F.lit(1))
    model = toxicity.learn(odd_docs, only)
    assert not model.weight.any()


def test_words_said_at_once_again_count_once():
    model = toxicity.Model(np.ones(toxicity.BUCKETS, np.float32), 0.0)
    once, twice = model.scores(["a b a b " * 8, "b b a a " * 8])
    assert once > twice


@pytest.fixture(scope="module")
def languages(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta".split()
    b = "uno dos tres cuatro cinco seis siete ocho".split()
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=30)), "aa" if i % 2 else "bb", f"h{i % 3}.x.{'aa' if i % 2 else 'bb'}", None) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA)


def test_languages_by_text_and_other_evidence(spark, languages):
    model = langid.learn(languages)
    host = F.col("source")
    args = dict(declared=F.col("lang"), suffix=langid.suffix_of(host), host=host, domain=langid.domain_of(host))
    rows = langid.identify(languages, model, **args).collect()
    assert all(r["language"] == r["lang"] and r["accepted"] for r in rows)
    short = spark.createDataFrame([(1, "zzz", "bb", "h0.x.bb", None), (2, "zzz", "aa", "h1.x.aa", None), (3, "123 !!", "aa", None, None), (4, None, None, None, None), (5, "", "aa", None, None)], SCHEMA)
    both = languages.unionByName(short).withColumn("language", F.lit("?"))
    got = {r["doc_id"]: r for r in langid.identify(both, model, **args).filter("source IS NULL OR n_chars IS NULL").collect() if r["text"] in (None, "", "zzz", "123 !!")}
    assert got[1]["language"] == "bb" and got[2]["language"] == "aa"  # the text is neutral, the rest decides
    for k in (3, 4, 5):
        assert (got[k]["language"], got[k]["accepted"], got[k]["confidence"]) == ("und", False, 0.0)
    assert langid.identify(languages.limit(0), model, **args).count() == 0


def test_evidence_from_pages(spark):
    page = spark.createDataFrame([("https://a.b.example.de/x?y#z", "<!DOCTYPE html>\n<html class='k' lang='DE-at'><script>var t='<p>hidden</p>'</script><p>seen <b>text</b><!-- no --></p>")], "url string, html string")
    host = langid.host_in(F.col("url"))
    r = page.select(langid.declared_in(F.col("html")).alias("d"), host.alias("h"), langid.suffix_of(host).alias("s"), langid.domain_of(host).alias("o")).first()
    assert tuple(r) == ("de", "a.b.example.de", "de", "example.de")
    assert langid.HIDDEN.sub(" ", page.first()["html"]).split() == ["seen", "text"]
    bad = spark.createDataFrame([("not a url %%%",), (None,)], "url string").select(langid.host_in(F.col("url")).alias("h")).collect()
    assert [b["h"] for b in bad] == [None, None]


def test_bands_reach_their_recall():
    bands, rows = passages.tune_bands(0.8, 0.98, 8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.98 and bands <= 8
    assert (passages.BANDS, passages.ROWS) == passages.tune_bands(most=6)


def test_paragraphs_are_cut_by_content():
    shared = prose(120, 77)
    one, other = prose(31, 1)[:-1] + " " + shared, prose(58, 2)[:-1] + " " + shared + " " + prose(20, 3)
    digests = []
    for t in (one, other):
        _, hashes, first, _ = passages.paragraphs([t])
        digests.append(set(passages.sentence_grain(hashes, first).tolist()))
    assert len(digests[0] & digests[1]) >= 5
    words, hashes, first, starts = passages.paragraphs(["", "a b c", "", "d\n\ne f"])
    assert words == list("abcdef") and first.tolist() == [0, 3, 4] and starts.tolist() == [0, 0, 1, 1, 3]
    assert len(passages.paragraphs(["w " * 5000])[2]) >= 9


def windows(text, n=50):
    words = (text or "").split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_repeated_passages_go_and_clean_documents_stay(spark, odd_docs, no_docs):
    passage, other = prose(140, 501), prose(70, 502)
    near = passage.split()
    near[17], near[90] = "changed", "words"
    rows = [(i, prose(80, i)) for i in range(20)]
    rows += [(20 + i, f"{prose(33, 200 + i)} {passage} {prose(25, 300 + i)}") for i in range(30)]
    rows += [(60, f"{prose(20, 600)}\n{' '.join(near)}\n{prose(20, 601)}"), (61, other), (62, other + "\n" + prose(50, 603)), (None, passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("removed_words", F.lit(2))
    got = {r["doc_id"]: r for r in passages.remove_repeated(table).collect()}
    for i in [*range(21), 61, None]:
        assert got[i]["text"] == dict(rows)[i] and got[i]["removed_words"] == 0 and got[i]["removed_spans"] == []
    target = windows(passage)
    for i in [*range(21, 50), 60]:
        assert not windows(got[i]["text"]) & target and got[i]["removed_words"] >= 90
        assert windows(got[i]["text"], 10) & windows(dict(rows)[i], 10)
    assert not windows(got[62]["text"]) & windows(other)
    again = passages.remove_repeated(odd_docs).collect()
    assert len(again) == odd_docs.count()
    by = {r["doc_id"]: r for r in again}
    assert by[7]["removed_words"] == 0 and by[8]["text"] == "" and by[1]["text"] is None and by[2]["text"] == ""
    assert passages.remove_repeated(no_docs).count() == 0


def test_removal_keeps_the_rest():
    text = "One two three. " + "x " * 30 + "\nlast line"
    assert passages.remaining(text, [(15, 75)]) == "One two three. last line"


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(8)
    passage = prose(100, 9000)
    rows = [(i, prose(150, i), "en", f"s{i % 4}", None) for i in range(60)]
    rows += [(100 + i, f"{prose(60, 400 + i)}\n{passage}", "en", "s0", None) for i in range(6)]
    rows += [(200, rows[0][1], "en", "s1", None), (201, " ".join(w if k != 40 else "other" for k, w in enumerate(rows[1][1].split())), "en", "s1", None), (300, "...", "en", "s1", None), (301, None, None, None, None)]
    labels = []
    for i in range(400, 520):
        words = prose(60, i).split()
        if i % 2:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["grumblefoot", "snotwaffle"]))
        rows.append((i, " ".join(words), "en", "s2", None))
        labels.append((i, 1, i % 2))
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    every = {r[0] for r in rows}
    assert every - set(seen[0]) == {300, 301}
    gone = set(seen[0]) - set(seen[1])
    assert len(gone & {i for i, _, y in labels if y}) >= 55 and len(gone - {i for i, _, y in labels if y}) <= 15
    assert set(seen[1]) - set(seen[2]) == {200, 201} & set(seen[1])
    assert sum(bool(windows(t) & windows(passage)) for t in seen[3].values()) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(seen[3])


def test_passages_inside_sentences_and_edited_paragraphs_go(spark):
    rng = random.Random(21)
    bare = lambda n, seed: prose(n, seed).replace(".", "").lower()
    rows, passage = [], {}
    for k in range(60):  # 51 to 80 words in the middle of a sentence, or of text without sentences
        passage[k] = bare(rng.randint(51, 80), 3000 + k)
        side = bare if k % 2 else lambda n, seed: prose(n, seed)[:-1]
        rows += [(2 * k, f"{side(30, 4000 + k)} {passage[k]} {bare(7, 4500 + k)}. {prose(20, 4700 + k)}"), (2 * k + 1, f"{side(41, 5000 + k)} {passage[k]} {side(23, 5500 + k)}")]
    for k in range(20):  # a paragraph with one word changed
        words = prose(60, 6000 + k).split()
        rows.append((1000 + 2 * k, f"{prose(30, 6100 + k)}\n{' '.join(words)}\n{prose(30, 6200 + k)}"))
        words[rng.randrange(60)] = "changed"
        rows.append((1001 + 2 * k, f"{prose(30, 6300 + k)}\n{' '.join(words)}\n{prose(30, 6400 + k)}"))
    got = {r["doc_id"]: r for r in passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(got[i]["text"] == texts[i] for i in texts if i % 2 == 0)
    exact = [got[2 * k + 1]["text"] == texts[2 * k + 1].replace(passage[k] + " ", "") for k in range(60)]
    assert np.mean(exact) > 0.95
    assert sum(got[1001 + 2 * k]["removed_words"] == 60 for k in range(20)) >= 19


@pytest.mark.parametrize("own", [True, False])
def test_passages_of_which_a_part_also_stands_elsewhere_go_whole(spark, own):
    """25 words of each passage also stand alone, earlier in the keeper or in a document before it."""
    rng = random.Random(22)
    bare = lambda n, seed: prose(n, seed).replace(".", "").lower()
    rows, passage = [], {}
    for k in range(150):
        n = rng.randint(52, 60)
        words = bare(n, 13_000 + k).split()
        at = rng.choice([0, rng.randint(1, n - 26), n - 25])
        part = " ".join(words[at : at + 25])
        passage[k] = " ".join(words)
        alone = f"{bare(30, 14_000 + k)} {part} {bare(31, 15_000 + k)}"
        rows += [(3 * k, bare(40, 16_000 + k) if own else alone)]
        rows += [(3 * k + 1, f"{alone if own else bare(33, 17_000 + k)} {passage[k]} {bare(27, 18_000 + k)}")]
        rows += [(3 * k + 2, f"{bare(41, 19_000 + k)} {passage[k]} {bare(23, 20_000 + k)}")]
    got = {r["doc_id"]: r for r in passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(got[i]["text"] == texts[i] for i in texts if i % 3 < 2)
    whole = [not windows(got[3 * k + 2]["text"]) & windows(passage[k]) and got[3 * k + 2]["removed_words"] >= len(passage[k].split()) for k in range(150)]
    assert all(whole), sum(whole)


def test_a_passage_goes_on_as_far_as_its_long_last_unit():
    """Words that fall make no cut inside a line, so the last unit is longer than AROUND."""
    head = [f"w{i}" for i in range(40)]
    hashes = passages.Words().hashes([f"t{i}" for i in range(4000)])
    tail = [f"t{i}" for i in np.argsort(hashes)[::67][:55]]
    texts = [" ".join([*[f"a{i}" for i in range(30)], *head, *tail, *[f"b{i}" for i in range(30)]]), " ".join([*[f"c{i}" for i in range(30)], *head, *tail, *[f"d{i}" for i in range(30)]])]
    words, own, first, starts = passages.paragraphs(texts)
    small, grain = passages.shortened(own), passages.sentence_grain(own, first).view(np.int64).tolist()
    a = [u for u in range(starts[0], starts[1]) if grain[u] in grain[starts[1] :]]
    edges = [*first.tolist(), len(words)]
    found = {grain[u]: [{"before": small[: edges[u]][::-1].tobytes(), "after": small[edges[u + 1] : edges[starts[1]]].tobytes()}] for u in a}
    (cuts, removed), = passages.without([texts[1]], [found])
    assert removed == 95 and texts[1][cuts[0][0] : cuts[0][1]] == " ".join([*head, *tail])


def test_every_labelled_language_is_known(spark):
    rng = random.Random(33)
    rows = []
    for k in range(40):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=30)), f"l{k:02d}", "s", None) for i in range(4 if k else 12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(docs)
    assert len(model.languages) == 40
    got = langid.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()
    assert all(r["accepted"] and r["language"] == r["lang"] for r in got)


def test_a_words_grams_do_not_depend_on_other_words():
    words = ["a", "word", "wordier", "x" * 40, "naïve", "supercalifragilistic"]
    flat, counts = toxicity.grams(words)
    ends = np.cumsum(counts)
    for w, a, b in zip(words, ends - counts, ends, strict=True):
        assert toxicity.grams([w])[0].tolist() == flat[a:b].tolist()
