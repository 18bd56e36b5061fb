import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.encoder import Encoder
from plumbline.llm.packing import encode_pieces, fullest, pack, plan, sequences

WORD = public_tokenizers.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_fullest_is_the_best_subset(counts, room):
    got = fullest(counts, room)
    assert all(n <= counts[k] for k, n in got.items())
    own = [k for k, n in counts.items() for _ in range(n)]
    best = max(s for r in range(len(own) + 1) for c in itertools.combinations(own, r) if (s := sum(c)) <= room) if len(own) < 13 else None
    assert best is None or sum(k * n for k, n in got.items()) == best


@given(st.dictionaries(st.integers(1, 50), st.integers(0, 60), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_places_each_piece_once(counts):
    places, n = plan(counts, 50)
    fill, used = defaultdict(int), Counter()
    for length, first, sequence, each, offset in places:
        assert first == used[length]
        last = min((p.first for p in places if p.length == length and p.first > first), default=counts[length])
        used[length] = last
        for i in range(last - first):
            assert offset + i % each * length <= 50 - length
            fill[sequence + i // each] += length
    assert used == Counter({k: v for k, v in counts.items() if v})
    assert sorted(fill) == list(range(n)) and all(x <= 50 for x in fill.values())


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1.2, 20_000).astype(int), 1, 2048)
    _, n = plan(dict(Counter(lengths.tolist())))
    assert n <= -(-int(lengths.sum()) // 2048) * 1.002


def test_pieces_and_places(spark):
    rows = [(i, "word " * (i * 37 % 900 + 1), "x", 1, "p") for i in range(60)] + [(None, "no id", "x", 1, "p"), (7, "again", None, None, None), (60, None, None, None, None), (61, "", None, None, None), (62, "one two " * 9000, None, None, None), (63, "a " * 2047, None, None, None), (64, "a " * 2048, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, part string").repartition(5)
    packed = pack(encode_pieces(docs, WORD, False, 0))
    got = packed.collect()
    e, want = Encoder(WORD, False), []
    for doc_id, text, *_ in rows:
        raw = e.whole(text or "") + bytes(4)
        for piece, at in enumerate(range(0, len(raw), 8192)):
            want.append((doc_id, piece, at // 4, len(raw[at : at + 8192]) // 4, zlib.crc32(raw[at : at + 8192])))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    assert all(whole[s].length == sum(x for _, x in own) == len(whole[s].ids) // 4 for s, own in by.items())
    assert pack(encode_pieces(docs.limit(0), WORD, False, 0)).collect() == []
