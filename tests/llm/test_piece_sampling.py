import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm.piece_sampling import Pieces, decode_pieces, sample_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["Hello  world", " lead", "trail  ", "", None, "a\n\nb\tc", "漢字 \U0001f642 ok ▁ x", "don't (stop),  été Ǆx", "   ", "x" * 3000, "\x00​́", "10.5%---== a_b"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL, 8000.0)


def test_decoding_is_lossless_and_draws_hang_on_the_key_only(pieces):
    keys = np.arange(len(HARD), dtype=np.uint64)
    got = pieces.sample(HARD, keys, 3)
    assert [pieces.decode(x) for x in got] == [t or "" for t in HARD]
    for i, t in enumerate(HARD):
        assert pieces.sample([t], keys[i : i + 1], 3)[0].tolist() == got[i].tolist()
    assert [x.tolist() for x in pieces.sample(HARD, keys + np.uint64(99), 3)] != [x.tolist() for x in got]
    assert [x.tolist() for x in pieces.sample(HARD, keys, 4)] != [x.tolist() for x in got]


def test_samples_follow_the_lattice(pieces):
    text, weight = "these", {}
    by = {pieces.raw[i].decode(): w for i, w in zip(pieces.ids.tolist(), pieces.weights.tolist(), strict=True)}
    own = " " + text
    for cuts in itertools.product([0, 1], repeat=len(own) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(own[at : i + 1])
                at = i + 1
        if all(p in by for p in parts):
            weight[tuple(parts)] = np.exp(sum(by[p] for p in parts))
    total, n = sum(weight.values()), 20_000
    seen = Counter(tuple(pieces.raw[i].decode() for i in x) for x in pieces.sample([text] * n, np.arange(n, dtype=np.uint64)))
    assert set(seen) <= set(weight)
    for parts, w in weight.items():
        p = w / total
        assert abs(seen[parts] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_low_temperature_gives_the_best(pieces):
    cold = Pieces(MODEL, 0.5)
    a, b = (cold.sample(["some ordinary words here"], np.array([k], np.uint64))[0].tolist() for k in (1, 2))
    assert a == b


def test_tables(spark):
    rows = [(i if i != 3 else None, t, "x", "y", 1) for i, t in enumerate(HARD)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, id string, key int").repartition(3)
    back = decode_pieces(sample_pieces(docs, MODEL), MODEL).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in rows)
    assert all(len({bytes(r.ids) for r in back if r.doc_id == i}) == 1 for i in range(len(HARD)) if i != 3)
    assert decode_pieces(sample_pieces(docs.limit(0), MODEL), MODEL).collect() == []
