"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Every text becomes its set of word shingles, and the set a signature. Texts
   with equal sets are one class; only its first row goes on.
2. Signatures are cut into bands. Classes that agree in a whole band share a
   bucket. Buckets with the same members are one.
3. Within a bucket signatures are compared in batches. After each batch the
   posterior probability that the similarity reaches the threshold, given the
   agreements so far, is bounded below by the chosen miss probability, and what
   falls under it is dropped. Survivors are verified on their full sets.
4. Verified links make the components.

No pair leaves a task: it emits links that join what it hasn't joined yet. A
bucket above a bound of rows or bytes is cut into blocks. Each block first meets
a few leaders of its bucket, so every set travels once and a large group of near
copies falls into one component. Then only the members outside the bucket's
largest component, block by block, are compared with all members of the bucket.
So each pair that isn't joined yet is looked at, and nothing is capped, but a
group with a third of all rows costs in proportion to its rows.
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Iterator
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import drop_rows, files_of, holding, mapped, new_folder, put_file, quoted, text_batches, written
from plumbline.llm.shingles import HASHES, forget, mixed, shingles, signature

#: Least similarity of a link, in hundredths.
THRESHOLD = 85
#: Chance at which a pair at the threshold may share no bucket.
UNSEEN = 1e-5


@functools.lru_cache(maxsize=16)
def bands_for(threshold: int) -> tuple[int, int]:
    """Bands and hashes in each: the longest bands, and as few of them, that keep the chance below ``UNSEEN``."""
    for size in range(8, 0, -1):
        n = -(-log(UNSEEN) // log(1 - (threshold / 100) ** size)) if threshold < 100 else 1
        if n * size <= HASHES:
            return int(n), size
    raise ValueError(f"{HASHES} hashes are too few for a threshold of {threshold}")


BANDS, BAND_HASHES = bands_for(THRESHOLD)
#: Chance at which a pair that reaches the threshold may be dropped, and hashes between two looks.
MISS, BATCH = 1e-6, 32
#: Rows and bytes of sets in a block of a bucket; leaders of a bucket that has several.
BLOCK_ROWS, BLOCK_BYTES, LEADERS = 384, 16_000_000, 16
_FACTORS = np.random.default_rng(5).integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def bands(own: np.ndarray, n: int = BANDS, size: int = BAND_HASHES) -> np.ndarray:
    """The keys of a signature's bands."""
    values = own[: n * size].reshape(n, size).astype(np.uint64)
    return mixed((mixed(values) * _FACTORS[:size]).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@functools.lru_cache(maxsize=16)
def least_agreements(n: int, threshold: int = THRESHOLD, miss: float = MISS) -> int:
    """Fewest agreements in ``n`` hashes at which P(similarity >= threshold) is still ``miss`` or more, from a uniform prior."""
    t, total = threshold / 100, 0.0
    for m in range(n + 1):
        # the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum
        total += comb(n + 1, m) * np.exp(m * log(t) + (n + 1 - m) * log(1 - t))
        if total >= miss:
            return m
    return n


@holding(forget)
def _survey(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, threshold: int) -> Iterator[pa.RecordBatch]:
    """For each text: node, id, hash of the text, number of shingles, class, bands."""
    part, row = TaskContext.get().partitionId(), 0
    schema = pa.schema([("part", pa.int32()), ("node", pa.int64()), ("id", id_type), ("hash", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            rows = batch.slice(i, 1024)
            sizes, classes, keys = [], [], []
            for text in rows["text"].to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                keys.append(bands(signature(own), *bands_for(threshold)) if len(own) else None)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array((part << 36) + row + np.arange(n)), rows["id"], rows["hash"], pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
            row += n


_PLACES = [("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int64())), ("leads", pa.list_(pa.bool_()))]


def _ask(asked: pa.Table, folder: str) -> pa.Table:
    """What is asked of one partition, as a file for its second reading."""
    part, out = asked["part"][0].as_py(), io.BytesIO()
    with pa.ipc.new_file(out, asked.schema) as writer:
        writer.write_table(asked)
    put_file(f"{folder}/{part}", "asked", out.getvalue())
    return pa.table({"part": pa.array([part], pa.int32())})


def _asked(folder: str, part: int) -> dict[int, tuple]:
    """By hash of the text: node, buckets and their blocks, of the texts of a partition whose sets are needed."""
    out: dict[int, tuple] = {}
    for data in files_of(f"{folder}/{part}").values():
        rows = pa.ipc.open_file(data).read_all()
        out.update(zip(rows["hash"].to_pylist(), zip(*(rows[c].to_pylist() for c, _ in _PLACES), strict=True), strict=True))
    return out


def _with_sets(places: list[tuple], texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """(node, keys, blocks, leads, set, sig); 16 bits of each hash are enough to compare."""
    for i in range(0, len(places), 256):
        own = [shingles(t) for t in texts.slice(i, 256).to_pylist()]
        sigs = [(signature(s) & np.uint32(0xFFFF)).astype("<u2").tobytes() for s in own]
        columns = [pa.array(x, t) for x, (_, t) in zip(zip(*places[i : i + 256], strict=True), _PLACES, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in own], pa.binary()), pa.array(sigs, pa.binary())], names=[*(c for c, _ in _PLACES), "set", "sig"])


@holding(forget)
def _sets(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that are asked for and still in the partition they were in."""
    asked = _asked(folder, TaskContext.get().partitionId())
    for batch in batches:
        places = [asked.pop(h, None) for h in batch["hash"].to_pylist()]
        wanted = batch["text"].filter(pa.array([x is not None for x in places], pa.bool_()))
        yield from _with_sets([x for x in places if x is not None], wanted)


@holding(forget)
def _late_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _with_sets(list(zip(*(batch[c].to_pylist() for c, _ in _PLACES), strict=True)), batch["text"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.root(b)] = self.root(a)


def bucket_links(sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray, groups: np.ndarray, due, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` (or among them, if both are one) that join all that is linked.

    Rows of one of ``groups`` are joined already; a pair is looked at if ``due(x, y)``.
    """
    sizes, forest, out = np.array([len(s) for s in sets]), _Forest(len(sets)), []
    lead: dict[int, int] = {}
    for i, g in enumerate(groups.tolist()):
        forest.join(lead.setdefault(g, i), i)
    same = left is right
    for k, x in enumerate(left):
        others = right[k + 1 :] if same else right
        near = others[(100 * sizes[others] >= threshold * sizes[x]) & (threshold * sizes[others] <= 100 * sizes[x]) & (groups[others] != groups[x])]
        agreed = np.zeros(len(near), np.int64)
        for at in range(0, HASHES, BATCH):
            if not len(near):
                break
            agreed += (sigs[near, at : at + BATCH] == sigs[x, at : at + BATCH]).sum(axis=1)
            go = agreed >= least_agreements(at + BATCH, threshold)
            near, agreed = near[go], agreed[go]
        for y in near[np.argsort(-agreed, kind="stable")].tolist():
            if forest.root(int(x)) == forest.root(y) or not due(int(x), y):
                continue
            at = np.searchsorted(sets[y], sets[x])
            both = int((sets[y][np.minimum(at, len(sets[y]) - 1)] == sets[x]).sum())
            if 100 * both >= threshold * (sizes[x] + sizes[y] - both):
                forest.join(int(x), y)
                out.append((int(x), y))
    return out


def _link(keys: tuple, rows: pa.Table, threshold: int) -> pa.Table:
    """Links of a whole bucket, of a block with its bucket's leaders, or of a block of the members yet to join (``left``) with a block of all.

    Of a pair that shares several buckets, that with the least key looks at it;
    leaders are compared at once.
    """
    key, kind = keys[0].as_py(), keys[1].as_py()
    node, side = rows["node"].to_numpy(), rows["left"].to_numpy(zero_copy_only=False).astype(bool)
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
    sigs = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(len(node), HASHES)
    own = [frozenset(x) for x in rows["keys"].to_pylist()]
    every = np.arange(len(node))
    left, right, groups = every, every, node
    least = lambda x, y: min(own[x] & own[y]) == key
    due = least
    if kind == LED:
        # its own leaders are in the block too
        left, right, due = np.flatnonzero(side), np.flatnonzero(~side), lambda x, y: node[x] != node[y]
    elif kind == REST:
        left, right, groups = np.flatnonzero(side), np.flatnonzero(~side), rows["label"].to_numpy()
    links = bucket_links(sets, sigs, left, right, groups, due, threshold)
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]})


#: Kinds of tasks over a bucket.
WHOLE, LED, REST = 0, 1, 2


def _all_links(spark: SparkSession, sets: DataFrame, members: DataFrame, threshold: int, block_rows: int) -> DataFrame:
    """(node, label) of the nodes that links join. ``members`` has key, blocks and node."""
    order = F.xxhash64("node")
    placed = sets.select("node", "keys", "set", "sig", F.explode(F.arrays_zip(F.col("keys").alias("key"), "blocks", "leads")).alias("to")).select("node", "keys", "set", "sig", "to.*")
    placed = placed.withColumn("block", F.pmod(order, F.col("blocks")))
    large = members.where("blocks > 1")
    found = lambda df: df.groupBy("key", "kind", "one", "two").applyInArrow(lambda keys, rows: _link(keys, rows, threshold), "a long, b long")
    columns = ["key", "kind", "one", "two", "node", "keys", "set", "sig", "left", "label"]

    def dealt(df: DataFrame, kind: int, one: Column, two: Column, left: bool, label: Column | None = None) -> DataFrame:
        return df.withColumns({"kind": F.lit(kind), "one": one, "two": two, "left": F.lit(left), "label": F.lit(None).cast("long") if label is None else label}).select(columns)

    nought, upto = F.lit(0).cast("long"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    if large.isEmpty():
        return components(written(found(dealt(placed, WHOLE, nought, nought, True)), "op2-links"))
    first = dealt(placed.where("blocks = 1"), WHOLE, nought, nought, True).unionByName(dealt(placed.where("blocks > 1"), LED, F.col("block"), nought, False)).unionByName(dealt(placed.where("leads"), LED, upto("blocks"), nought, True))
    links = written(found(first), "op2-links")
    labels = components(links)

    # members outside the largest component of their bucket
    told = large.join(labels, "node", "left").select("key", "node", "blocks", F.coalesce("label", "node").alias("label"))
    told = written(told, "op2-labels", narrow=True)
    most = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"))
    told = told.join(most, "key").select("key", "node", "blocks", "label", (F.col("label") != F.col("most.label")).alias("open"))
    parts = told.where("open").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts"))
    left = written(told.join(parts, "key"), "op2-open", narrow=True)
    if left.isEmpty():
        return labels
    again = sets.where("exists(blocks, b -> b > 1)").select("node", "keys", "set", "sig").join(left, "node")
    again = again.withColumn("block", F.pmod(order, F.col("blocks"))).withColumn("part", F.pmod(order, F.col("parts")))
    more = dealt(again.where("open"), REST, F.col("part"), upto("blocks"), True, F.col("label")).unionByName(dealt(again, REST, upto("parts"), F.col("block"), False, F.col("label")))
    return components(links.unionByName(written(found(more), "op2-links")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and the text's ``hash``.

    Linked are texts whose shingle sets have 100 * intersection >= threshold *
    union (verified on the full sets); ``component_id`` is the smallest id that
    links reach. A text without words, empty or null, has no shingle and stands
    alone. A null id takes part, but is a component's id only where it has no
    other. Of a component one row is kept: that with the component's id, and of
    rows that repeat this id one. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("hash"), F.col(quoted(text_col)).alias("text"))
    kind = rows.schema["id"].dataType
    survey = functools.partial(_survey, id_type=to_arrow_type(kind), threshold=threshold)
    survey = mapped(rows, survey, f"part int, node long, id {kind.simpleString()}, hash long, n long, class binary, bands array<long>", "op2-survey")

    # equal sets are one class, led by its first node
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    classes = written(survey.where("n > 0").groupBy("class").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("rows"), first), "op2-classes", narrow=True)
    leads = survey.join(classes.select(F.col("lead").alias("node")), "node", "left_semi").select("part", "node", "hash", "n", "bands")
    leads = written(leads, "op2-leads", narrow=True)

    # buckets with more than one class; of those with the same members one
    held = leads.select("node", "n", F.explode("bands").alias("key"))
    many = held.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.sum("n").alias("n")).where("rows > 1")
    buckets = many.groupBy("rows", "least", "sum").agg(F.min("key").alias("key"), F.min("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("n") * 8 / BLOCK_BYTES)).cast("long")
    # leaders take no more room than a quarter of a block
    few = F.greatest(F.lit(1), F.least(F.lit(LEADERS), F.ceil(F.col("rows") / blocks / 4))).cast("int")
    buckets = written(buckets.select("key", blocks.alias("blocks"), few.alias("few")), "op2-buckets", narrow=True)
    members = written(held.join(buckets, "key").select("key", "blocks", "few", "node"), "op2-members", narrow=True)
    # of a bucket of several blocks one member leads from each of a few classes by hash
    leaders = members.where("blocks > 1").groupBy("key", F.pmod(F.hash("node"), F.col("few")).alias("of")).agg(F.min("node").alias("node"))
    marked = members.join(leaders.select("key", "node", F.lit(True).alias("leads")), ["key", "node"], "left").select("node", F.struct("key", "blocks", F.coalesce("leads", F.lit(False)).alias("leads")).alias("own"))
    # a node has no more buckets than bands
    active = marked.groupBy("node").agg(F.collect_list("own").alias("own")).select("node", F.col("own.key").alias("keys"), F.col("own.blocks").alias("blocks"), F.col("own.leads").alias("leads"))

    # sets of those that share a bucket, from a second reading of their partitions, which are told where each goes
    folder = new_folder(spark, "op2-asked")
    asked = leads.select("part", "hash", "node").join(active, "node")

    def ask(own: pa.Table) -> pa.Table:
        return _ask(own, folder)

    asked.groupBy("part").applyInArrow(ask, "part int").agg(F.count(F.lit(1))).first()
    schema = "node long, keys array<long>, blocks array<long>, leads array<boolean>, set binary, sig binary"
    sets = mapped(rows.select("hash", "text"), functools.partial(_sets, folder=folder), schema, "op2-sets")
    # an input whose rows change places between readings leaves some out: those are joined by hash
    late = asked.join(sets.select("node"), "node", "left_anti").drop("part")
    if not late.isEmpty():
        late = written(late, "op2-late", narrow=True)
        texts = rows.select("hash", "text").join(late, "hash").dropDuplicates(["node"]).select("node", "keys", "blocks", "leads", "text")
        sets = sets.unionByName(mapped(texts, _late_sets, schema, "op2-late-sets"))
    labels = _all_links(spark, sets, members, threshold, block_rows)

    # by component, then by class, then by row
    known = classes.join(labels, classes["lead"] == labels["node"], "left").select("class", "rows", "first", F.coalesce("label", "lead").alias("label"), F.col("label").isNotNull().alias("linked"))
    known = written(known.where("linked or rows > 1"), "op2-known", narrow=True)
    best = known.groupBy("label").agg(F.min("first").alias("best"))
    told = written(known.join(best, "label").select("class", "best"), "op2-told", narrow=True)
    out = survey.select("node", "id", "hash", "n", "class").join(told, "class", "left")
    alone = F.col("best").isNull()
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"), (alone | (F.col("node") == F.col("best.node"))).alias("kept"), "hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep, with the columns it came with.

    Rows are told apart by id and text; of rows that agree in both, one stays
    where any does.
    """
    found = near_duplicates(docs, id_col, text_col, threshold)
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__key")).agg(F.max("kept").alias("kept"), F.min("kept").alias("all")).where("not all")
    return drop_rows(docs, F.xxhash64(F.col(quoted(text_col))), marks, id_col)
