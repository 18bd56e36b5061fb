"""The stages against plain Python on the smallest tables, and on rows with all that can be missing."""

import re
import zlib
from collections import defaultdict

import public_tokenizers

import corpus_pipeline
from plumbline.llm.encoder import Encoder
from tests.llm.test_near_dedup import brute

WORD = public_tokenizers.path("word_bpe_49k.json")


def kept_by_brute_force(rows):
    """(doc_id, text) of what the first three stages keep, for distinct ids; near-duplicates from a similarity of 0.8."""
    out = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    first = {}
    for r in sorted(out):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    out = sorted(first.values())
    return [r for r, (doc_id, _, component) in zip(out, sorted(brute(out, 80)), strict=True) if doc_id == component]


def held_against(spark, docs, rows, columns):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    left = sorted((r.doc_id, r.text) for r in docs.collect())
    assert left == kept_by_brute_force(rows)
    e, want = Encoder(WORD, False), []
    for doc_id, text in left:
        raw = e.whole(text) + bytes(4)
        want += [(doc_id, n, at // 4, len(raw[at : at + 8192]) // 4, zlib.crc32(raw[at : at + 8192])) for n, at in enumerate(range(0, len(raw), 8192))]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(by) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held_against(spark, docs, rows, docs.columns)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_missing_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, ids string"
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "Hello there"), (5, "Hello\tthere"), (6, "hello there"), (7, "漢字"), (8, "word " * 30_000), (9, "a b c d e f g"), (10, "a b c d e f g h")]
    docs = spark.createDataFrame([(*r, "en" if r[0] % 2 else None, None, None, None, "x", "y") for r in rows], schema)
    held_against(spark, docs, rows, docs.columns)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
        assert none.collect() == []


def test_documents_without_labels(spark):
    rows = [(1, None), (2, "12 !?"), (3, "Hello there"), (4, "hello\tthere"), (5, "漢字"), (6, "word " * 3000)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    held_against(spark, docs, rows, docs.columns)


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
