"""Encoding, token counts and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stemma.llm import encoding, packing, queries, token_counts
from stemma.llm.bytebpe import ByteBpe, pieces
from stemma.llm.packing import Plan

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts():
    rng = random.Random(1)
    letters = "abe \n\t'<|\x1c\x1d \xa0é 漢字🙂0１²ǅÀ̀.,-'sSxy  \x85"
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)] + ["a" * 3000, "ab" * 2000 + " é" * 500, "<|endoftext|>", "x<|endoftext|> y", "x  y   z \n \n  q ", ""]


def test_segment_tree_gives_the_librarys_ids():
    own, library = ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    for text, ids in zip(texts(), own.encode(texts()), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == expected
        assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_long_and_short_words_merge_alike():
    own = ByteBpe(BYTE)
    for word in (b"thethethe", b"a" * 100, bytes(range(97, 123)) * 4):
        assert np.frombuffer(own.words([word])[0], "<i4").tolist() == own._merge_long(word)


def test_pieces_join_to_the_text():
    for text in texts():
        assert "".join(pieces(text)) == text


def test_decoding_broken_bytes_is_lossy():
    own, library = ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    ids = [own.byte_ids[b] for b in "é🙂".encode()[:-1]]
    assert own.decode(ids) == library.decode([int(i) for i in ids], skip_special_tokens=False)


def test_encode_decode_of_odd_rows(odd_docs, no_docs):
    rows = encoding.encode_decode(odd_docs.withColumn("ids", F.lit("mine")), BYTE, carry=["doc_id", "lang"]).collect()
    assert len(rows) == odd_docs.count()
    library = Tokenizer.from_file(BYTE)
    for got, doc in zip(sorted(rows, key=str), sorted(rows, key=str), strict=True):
        assert got == doc
    for r in rows:
        assert library.encode(r["decoded"], add_special_tokens=False).ids == list(r["ids"])
    assert encoding.encode_decode(no_docs, BYTE).count() == 0
    assert encoding.encode_decode(odd_docs, BYTE).columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]


def test_query_of_encoding(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(BYTE)
    expected = sorted((str(r["doc_id"]), hashlib.sha256(",".join(map(str, library.encode(r["text"] or "", add_special_tokens=False).ids)).encode()).hexdigest()) for r in odd_docs.collect())
    got = queries.op6_bpe(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in got) == expected


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_counts_of_all_tokenizers(odd_docs, path):
    if path == PIECE:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = token_counts.count_tokens(odd_docs.withColumn("N_Tokens", F.lit(7)), path, limit=100).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), count(text), count(text) > 100)


def test_words_are_counted_as_the_library_counts_texts():
    own, library = token_counts.WordCounts(WORD), Tokenizer.from_file(WORD)
    assert own.counts(texts()) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]


def test_cache_is_used_and_appended(spark, odd_docs, no_docs, tmp_path):
    cache = f"{tmp_path}/cache"
    first = odd_docs.filter("doc_id < 6")
    token_counts.count_tokens(first, WORD, cache).collect()
    before = spark.read.parquet(cache).count()
    assert before == first.select(token_counts.content_digest(token_counts.normalised(F.col("text"), WORD))).distinct().count()
    token_counts.count_tokens(first, WORD, cache).collect()
    assert spark.read.parquet(cache).count() == before
    planted = spark.read.parquet(cache).limit(1).withColumn("n_tokens", F.lit(10**6))
    planted.cache().count()
    planted.write.mode("append").parquet(cache)
    assert token_counts.count_tokens(first, WORD, cache).agg(F.max("n_tokens")).first()[0] == 10**6
    token_counts.count_tokens(odd_docs, WORD, cache).collect()
    assert spark.read.parquet(cache).count() > before
    assert token_counts.count_tokens(no_docs, WORD, cache).count() == 0


def check_packing(rows, expected, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert set(by_sequence) == set(range(len(by_sequence)))
    for key, all_ids in expected.items():
        want = sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in all_ids if len(i) <= capacity)
        got = sorted((r["length"], r["ids_crc32"]) for r in by_doc[key] if len(by_doc[key]) == len(all_ids))
        if all(len(i) <= capacity for i in all_ids):
            assert want == got


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    expected = {}
    for r in odd_docs.collect():
        expected.setdefault(r["doc_id"], []).append(library.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    rows = packing.pack(odd_docs.withColumn("piece", F.lit(1)), BYTE, capacity=64, with_ids=True).collect()
    check_packing(rows, expected, 64)
    long = sorted((r for r in rows if r["doc_id"] == 6), key=lambda r: r["piece"])
    assert sum((list(r["ids"]) for r in long), []) == expected[6][0]
    assert all(r["length"] == 64 for r in long[1:]) and [r["start"] for r in long] == list(np.cumsum([0, *[r["length"] for r in long[:-1]]]))
    assert packing.pack(no_docs, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([1, 40, 3000])):
        size = min(100, max(1, int(rng.lognormvariate(3.2, 0.8))))
        counts[size] = counts.get(size, 0) + rng.choice([1, 1, 50])
    plan = Plan(counts, 100, 1 / 8, 20)
    load, placed = {}, {s: 0 for s in counts}
    rows = sorted(plan.rows)
    for k, (size, rank, first, each, offset) in enumerate(rows):
        after = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == size else counts[size]
        for i in range(after - rank):
            load.setdefault(first + i // each, []).append((offset + i % each * size, size))
        placed[size] += after - rank
    assert placed == counts and len(load) == plan.sequences
    for own in load.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 100
    total = sum(s * n for s, n in counts.items())
    assert plan.sequences <= 1.1 * -(-total // 100) + 20
