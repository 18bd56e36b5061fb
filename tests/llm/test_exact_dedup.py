import hashlib
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F

from plumbline.llm import golomb
from plumbline.llm.exact_dedup import drop_duplicates, exact_duplicates

COLUMNS = "doc_id long, text string, sha string, id string, keep_id long, norm string"


@given(st.sets(st.integers(0, 2**48 - 1)))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    values = sorted(values)
    assert golomb.decode(golomb.encode(np.array(values, np.uint64))).tolist() == values


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        own = groups[norm(r[1])]
        keep = min((x for x in own if x is not None), default=None)
        out.append((r[0], keep, len(own), hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(*pairs):
    return [(i, t, "a", "b", 7, None) for i, t in pairs]


def test_against_brute_force(spark):
    rows = rows_of((1, "a  b"), (2, "a\tb"), (3, "a\u00a0b"), (4, None), (5, ""), (6, " "), (None, "a b"), (None, "alone"), (None, "alone"), (8, "x"), (8, "x"), (8, "y"), (9, "long " * 30_000), (10, "long " * 30_000), *((100 + i, "hot") for i in range(300)))
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(r[1]) for r in rows}) and all(r.doc_id == r.keep_id for r in kept)
    left = drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, norm(r.text)) for r in left.collect()) == sorted((r.doc_id is None, r.doc_id or 0, next(norm(x[1]) for x in rows if hashlib.sha256(norm(x[1]).encode()).hexdigest() == r.text_sha256)) for r in kept)


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert exact_duplicates(none).collect() == [] and drop_duplicates(none).collect() == []


def test_any_column_names(spark):
    rows = [(1, "a  b", 1, 2, 3, 4), (2, "a b", 5, 6, 7, 8), (2, "a b", 5, 6, 7, 8), (None, "c", 1, 1, 1, 1), (None, "c", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, __own int, row int, `k``ey` int")
    left = drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def moving(spark, rows, columns, folder):
    """``rows`` as a table whose partitions are dealt out otherwise each time that they are read."""

    def deal(batches):
        part = TaskContext.get().partitionId()
        folder.joinpath(f"{part}-{uuid.uuid4().hex}").touch()
        times = len(list(folder.glob(f"{part}-*"))) - 1
        for batch in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for i, r in enumerate(rows) if (i + times) % 4 == part], schema=batch.schema)

    one = spark.createDataFrame([rows[0]] * 4, columns)
    names = one.columns
    return spark.range(4, numPartitions=4).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema)).mapInArrow(deal, one.schema)


def test_rows_that_change_partition_between_the_readings(spark, tmp_path):
    """The second reading finds rows that its sender hasn't sent: they are suspects, and the result is the same."""
    rows = rows_of(*((i, f"text {i % 37}") for i in range(60)), *((100 + i, f"alone {i}") for i in range(40)))
    got = exact_duplicates(moving(spark, rows, COLUMNS, tmp_path)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert len(list(tmp_path.iterdir())) >= 8


def test_texts_are_hashed_and_not_sorted_and_names_are_any(spark):
    docs = spark.createDataFrame([(1, "a  b"), (2, "a b"), (None, "a b"), (3, "c")], "`i.d` long, `te``xt` string")
    found = exact_duplicates(docs, "i.d", "te`xt")
    assert sorted((tuple(r[:4]) for r in found.collect()), key=str) == sorted([(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 1, True)], key=str)
    told = spark.createDataFrame([(b"x", "t", 1)], "sha binary, norm string, id long").groupBy("sha", "norm").agg(F.count(F.lit(1)), F.min("id"))
    assert "SortAggregate" not in told._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["te`xt"] for r in drop_duplicates(docs, "i.d", "te`xt").collect()) == ["a  b", "c"]
