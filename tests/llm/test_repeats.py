"""Removal of repeats (op12): the transform, whole documents and edge cases against a plain version."""

import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm.repeats import STEP, _runs, remove_repeats, repeated_starts


def plain(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for doc_id, x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((doc_id, kept, len(x), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone])) == 1))))
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], bytes(r[1]), *r[2:]) for r in df.collect()), key=str)


def test_blocks_against_counting():
    rng = random.Random(3)
    for _ in range(150):
        length, signs = rng.choice([1, 2, 3, 7, 20]), rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        base, texts = bytes(rng.choice(signs) for _ in range(60)), set()
        for _ in range(rng.randint(1, 12)):
            i = rng.randint(0, 40)
            text = bytearray(base[i : i + rng.randint(length, length + 30)])
            while len(text) < length:
                text.append(rng.choice(signs))
            if rng.random() < 0.5:
                text[rng.randrange(len(text))] = rng.choice(signs)
            texts.add(bytes(text))
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
        assert [x.tolist() for x in repeated_starts(list(texts), length)] == want


def test_runs_cover_all_starts_and_equal_strings_have_one_core():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 101, 900, dtype=np.uint8)
    one, other = (np.concatenate([rng.integers(97, 123, n, dtype=np.uint8), shared, rng.integers(97, 123, 50, dtype=np.uint8)]) for n in (37, 400))
    where = []
    for data in (one, other, np.full(1000, 97, np.uint8)):
        starts, counts, cores, _ = _runs(data, 400)
        assert np.array_equal(np.repeat(starts, counts) + np.concatenate([np.arange(c) for c in counts]), np.arange(len(data) - 399))
        where.append(np.repeat(cores, counts))
    assert np.array_equal(where[0][37 : 37 + 501], where[1][400 : 400 + 501])
    assert len(set(where[2])) == 1


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [say(12) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), say(rng.randint(0, 5))]
        out.append(" ".join(parts))
    return out + [out[0], out[0], out[1][:-1] + "#", "ab" * 90, "x" * 200, say(6) + "ab" * 30, "", None]


SCHEMA = "doc_id long, text string, row long, cores string, marks int"


@pytest.mark.parametrize(("length", "block_bytes", "core_runs"), [(40, 1_500_000, 2000), (24, 2000, 3), (40, 500, 0)])
def test_documents_against_counting(spark, length, block_bytes, core_runs):
    rows = [(i // 2 if i % 5 else None, t, 1, "c", None) for i, t in enumerate(texts(7, 60))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = found(remove_repeats(docs, length, block_bytes=block_bytes, core_runs=core_runs))
    assert got == plain(rows, length)
    assert 0 < sum(r[3] for r in got) < sum(r[2] for r in got)


def test_long_texts_over_their_steps(spark):
    rng = random.Random(5)
    passage, long = "".join(rng.choice("abcdef") for _ in range(700)), "".join(rng.choice("ghijkl ") for _ in range(2 * STEP + 1000))
    cut = STEP - 300  # the passage lies across the border of two steps
    rows = [(1, long[:cut] + passage + long[cut:]), (2, "start " + passage + " end")]
    got = found(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400))
    assert [r[3:] for r in got] == [(700, 1), (700, 1)]
    assert {bytes(r[1]) for r in got} == {long.encode(), b"start  end"}


def test_empty_table_odd_names_and_bounds(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([("k", "one two three"), ("l", "one two four")], "`i.d` string, `te``xt` string")
    assert found(remove_repeats(docs, 8, "i.d", "te`xt")) == plain([("k", "one two three"), ("l", "one two four")], 8)
    with pytest.raises(ValueError):
        remove_repeats(docs, 0, "i.d", "te`xt")
