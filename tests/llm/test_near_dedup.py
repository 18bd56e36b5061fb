import random
import re

import numpy as np
import pytest

from plumbline.llm.components import components
from plumbline.llm.near_dedup import BAND_HASHES, BANDS, MISS, UNSEEN, bands_for, drop_near_duplicates, least_agreements, near_duplicates
from plumbline.llm.shingles import HASHES
from tests.llm.test_exact_dedup import moving

SCHEMA = "doc_id long, text string, node string, hash string, n int, class string"


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=85):
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 5000)
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 120, 300]))]
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):  # chains of edits, so that components aren't cliques
            base = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                base[rng.randrange(len(base))] = word()
            rows.append(base)
    return [(i * 3 % 1009, rng.choice([" ", "\n", "  "]).join(w), "x", "y", 1, "z") for i, w in enumerate(rows)]


@pytest.mark.parametrize(("block_rows", "threshold"), [(1024, 85), (3, 85), (1024, 80), (3, 80)])
def test_against_brute_force(spark, block_rows, threshold):
    rows = corpus(4) + [(2000, None, None, None, None, None), (2001, "", None, None, None, None), (2002, " \n", None, None, None, None), (2003, "one two", None, None, None, None), (2004, "ONE\ttwo", None, None, None, None), (2005, "One twÖ", None, None, None, None), (None, "one two", None, None, None, None), (None, "of no id", None, None, None, None), (None, "of no id", None, None, None, None), (2003, "one two", None, None, None, None), (2010, "big word " * 30_000 + " end", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_duplicates(docs, threshold=threshold, block_rows=block_rows).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, threshold)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.component_id for r in kept)
    groups = [r.component_id for r in got if r.component_id is not None and r.n_shingles]
    assert len([r for r in kept if r.n_shingles and r.doc_id is not None]) == len(set(groups))


def test_a_large_group_over_many_blocks(spark):
    rng = random.Random(1)
    base = ["b%d" % i for i in range(200)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(200)] = "e%d" % rng.randint(0, 10**6)
        rows.append((i, " ".join(own), "", "", 0, ""))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), block_rows=64).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_rows_are_dropped_whole(spark):
    rows = [(5, "a b c d e f", "", "", 0, ""), (5, "a b c d e f", "", "", 0, ""), (4, "a b c d e f", "", "", 0, ""), (4, "a B c d e f", "", "", 0, ""), (9, None, "", "", 0, ""), (8, None, "", "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 8, 9]
    assert drop_near_duplicates(docs.limit(0)).collect() == [] and near_duplicates(docs.limit(0)).collect() == []


def test_bounds_keep_pairs_at_the_threshold():
    assert (1 - 0.85**BAND_HASHES) ** BANDS < 1e-5
    rng = np.random.default_rng(0)
    agree = rng.random((200_000, HASHES)) < 0.85
    lost = np.zeros(len(agree), bool)
    for n in (32, 64, 96, 128):
        lost |= agree[:, :n].sum(axis=1) < least_agreements(n)
    assert lost.mean() < 1e-4 and MISS <= 1e-6
    assert least_agreements(128) > 0.6 * 128


@pytest.mark.parametrize("threshold", [80, 85, 90, 100])
def test_bands_of_a_threshold(threshold):
    n, size = bands_for(threshold)
    assert n * size <= HASHES and (1 - (threshold / 100) ** size) ** n <= UNSEEN


def test_a_bucket_of_many_small_groups(spark):
    """Texts with much in common that aren't near duplicates, but for some: no leader stands for them."""
    rng = random.Random(2)
    base, rows = ["b%d" % i for i in range(150)], []
    for i in range(90):
        own = base + ["u%d-%d" % (i, j) for j in range(40)]
        rows.append((3 * i, " ".join(own), "", "", 0, ""))
        if i % 3 == 0:
            own[rng.randrange(150)] = "e%d" % i
            rows.append((3 * i + 1, " ".join(own), "", "", 0, ""))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), block_rows=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_rows_that_change_partition_between_the_readings(spark, tmp_path):
    rows = corpus(7, 20)
    got = near_duplicates(moving(spark, rows, SCHEMA, tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 1)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
