import numpy as np
import pytest

from plumbline.llm.hamming import MultiIndex, nearest

SCHEMA = "vec_id long, embedding array<float>, code string, ids int, q string"


def brute(rows, k):
    code = lambda v: sum(1 << i for i, x in enumerate(v) if x is not None and x > 0)
    own = sorted({(r[0], code(r[1])) for r in rows if r[0] is not None and r[1] is not None})
    out = []
    for q, c in own:
        if q % 20 == 0:
            best = sorted(((c ^ d).bit_count(), i) for i, d in own if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "k"), [((1 << 18, 1 << 16), 10), ((40, 3), 5)])
def test_against_brute_force(spark, blocks, k):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(size=64) * 0.7).tolist(), "c", 1, "q") for i in range(200)]
    rows += [(1000 + i, centres[0].tolist(), "c", 1, "q") for i in range(100)]  # one code, many ids
    rows += [(None, [1.0] * 64, None, None, None), (300, None, None, None, None), (320, [], None, None, None), (340, [None] * 64, None, None, None), (0, rows[0][1], None, None, None)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = nearest(vectors, vectors.where("vec_id % 20 = 0"), k, block_codes=blocks[0], block_queries=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


def test_few_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0], "", 0, ""), (20, [-1.0], "", 0, "")], SCHEMA)
    assert sorted(map(tuple, nearest(vectors, vectors).collect())) == [(0, 1, 20, 1), (20, 1, 0, 1)]
    assert nearest(vectors.limit(0), vectors.limit(0)).collect() == []


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=150 if i % 7 else 90)).tolist(), "", 0, "") for i in range(120)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = nearest(vectors, vectors.where("vec_id % 20 = 0"), 7, block_codes=50).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7)


def test_an_id_has_one_code(spark):
    vectors = spark.createDataFrame([(0, [1.0, 1.0], "", 0, ""), (0, [-1.0, 1.0], "", 0, ""), (1, [1.0, -1.0], "", 0, ""), (1, [-1.0, -1.0], "", 0, "")], SCHEMA)
    assert [tuple(r) for r in nearest(vectors, vectors.where("vec_id = 0")).collect()] == [(0, 1, 1, 1)]


def test_search_stops_once_covered():
    codes = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    index = MultiIndex(codes)
    places, far = index.search(codes[17], lambda at, *_: len(at) >= 1)
    assert far[0] == 0 and codes[places[0]] == codes[17] and len(places) < len(codes) // 10
