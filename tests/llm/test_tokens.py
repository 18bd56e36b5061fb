"""Encoder, shards (op4) and flat files (op3) against the library's own results."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import sstable
from plumbline.llm.encoder import Encoder, narrow
from plumbline.llm.flat_tokens import token_counts
from plumbline.llm.token_output import lookup, read_shards, write_shards

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["a\xa0 b", "a \n\n b  c\n", "\n x", "'s it's  'S <|endoftext|> x", "", "x\x1c y", "  ", "a\u3000 b\t\tc \n d", "É́ é", "ÀB.! foo?.", "a<|endof text|>b", " \n\n\n", "x\r\ny z\x85w", "\nAbc,&&& x's", "漢字 かな 🙂 ok", "1234 5,6", "ΣΑΣ. ÖÄ", None]


@pytest.mark.parametrize(("path", "keeps"), [(BYTE, True), (WORD, False)])
def test_words_encode_as_whole_texts_do(path, keeps):
    e = Encoder(path, keeps)
    for _ in range(2):  # the second time from the table
        for text, got in zip(HARD, e.encode(HARD), strict=True):
            assert got == e.whole(text or "")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, id string, path string, start long")


ROWS = [(i * 7 % 18, x, "own", None, 5) for i, x in enumerate(HARD)] + [(None, "no id", "x", "y", 1), (3, "again", "x", "y", 1), (40, "long " * 40_000, None, None, None), (-5, "below", None, None, None)]


def test_shards_round_trip(spark):
    shards = write_shards(docs_of(spark, ROWS), BYTE, True, 2)
    got = [tuple(r) for r in read_shards(spark, shards, ids=True).collect()]
    e = Encoder(BYTE, True)
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        raw = e.whole(text or "") + np.array([2], "<u4").tobytes()
        want.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), np.frombuffer(raw, "<u4").tolist()))
        start += len(raw) // 4
    assert sorted(got, key=lambda x: x[1]) == want
    found = {r["doc_id"]: list(r["ids"]) for r in lookup(shards, [None, -5, 40, 999]).collect()}
    assert found == {w[0]: w[4] for w in want if w[0] in (None, -5, 40)}


def test_shard_lookup_over_many_blocks():
    file = io.BytesIO()
    writer = sstable.Writer(file)
    ids = [None, None, *range(-50, 3000, 3), 2998, 2998]
    for i in ids:
        writer.add(i, np.arange((i or 0) % 400, dtype="<u4"))
    writer.close()
    reader = sstable.Reader(file)
    assert len(reader.places) > 1
    assert [i for i, _ in reader.scan()] == ids
    for i in range(-60, 3010):
        got = reader.get(i)
        assert (got is not None) == (i in ids)
        assert got is None or len(got) == i % 400
    with pytest.raises(ValueError):
        writer.add(0, np.zeros(1, "<u4"))
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(file.getvalue()[:-3]))


@pytest.mark.parametrize("block_ids", [1, 3, 7, 1 << 20])
def test_flat_counts(spark, block_ids):
    rows = [r for r in ROWS if r[0] != 40] + [(40, "long " * 50, None, None, None)]
    got = sorted(tuple(r) for r in token_counts(docs_of(spark, rows).coalesce(2), WORD, False, 49407, block_ids=block_ids).fillna(-9).collect())
    e = Encoder(WORD, False)
    assert got == sorted((-9 if r[0] is None else r[0], len(e.whole(r[1] or "")) // 4 + 1) for r in rows)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert token_counts(none, WORD, False, 49407).collect() == []
    assert read_shards(spark, write_shards(none, BYTE, True, 2)).collect() == []


def test_ids_that_do_not_fit_are_refused():
    wide = np.array([1, 65536], "<u4")
    assert narrow(wide[:1].tobytes()) == b"\1\0" and narrow(b"") == b""
    with pytest.raises(ValueError, match="65536"):
        narrow(wide.tobytes())
    with pytest.raises(ValueError, match="65536"):
        sstable.Writer(io.BytesIO()).add(1, wide)
    file = io.BytesIO()
    writer = sstable.Writer(file, 4)
    writer.add(1, wide)
    writer.close()
    assert sstable.Reader(file).get(1).tolist() == [1, 65536]


def test_many_partitions_keep_the_order_of_ids(spark):
    rows = [(i * 37 % 1000 - 300, f"text {i}", "x", "y", 1) for i in range(1000)] + [(None, "none", "x", "y", 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        shards = write_shards(docs_of(spark, rows), BYTE, True, 2)
        assert shards.count() > 10
        got = [r.doc_id for r in read_shards(spark, shards).orderBy("start").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [None, *range(-300, 700)]
