"""Removal of long byte strings that repeat anywhere in a corpus, by interval expansion on Burrows-Wheeler transforms.

A string of ``length`` bytes that starts at two places has the same anchor at
both: the smallest hash of ``GRAM`` bytes inside it. The starts of a document
fall into runs that share an anchor and a range of distances from it, and all
strings of a run hold one core, most of their bytes. So equal strings have
equal cores, and what must be compared are the runs of one core:

1. Each document's runs are found, with hashes of their cores and of their
   whole bytes, and written with the text. Cores are counted: what occurs once
   can't repeat, and runs of equal bytes are folded into one with a number.
2. Cores with several different runs are dealt into blocks of a bounded size.
   Over the runs of a block, each once, a Burrows-Wheeler transform is built,
   and its intervals are expanded backwards, breadth first, by one sign a round:
   that gives the common prefixes of neighbours in order of their length, and
   stops at ``length``. Neighbours without a shorter one repeat.
3. A core with very many different runs (a passage that goes on differently
   in each document) has no block: its strings are counted one by one.
4. Marks go back to the documents, which lose the bytes that they cover.

Runs of a core that are equal are told by 64 bits of hash beside those of the
core; everything else is compared byte by byte.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import mapped, quoted, text_batches, written
from plumbline.llm.shingles import mixed

#: The bytes of a repeated string, at least.
LENGTH = 400
#: Bytes of runs in a block, on the average.
BLOCK_BYTES = 1_500_000
#: Different runs of a core in a block, at most; a core with more is counted string by string.
CORE_RUNS = 2000
#: Starts of a long text that are looked at together.
STEP = 1 << 18
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, _INVERSE))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def _shape(length: int) -> tuple[int, int]:
    """Bytes of an anchor, and starts of a run at most."""
    return max(1, length // 6), max(1, length // 4)


def _runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, number of starts, core, content) of the runs of a text, in order."""
    gram, reach = _shape(length)
    found = []
    for at in range(0, len(data) - length + 1, STEP):
        part = data[at : at + STEP + length - 1]
        n, window = len(part), length - gram + 1
        power, inverse = _powers(STEP + length)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[:n], out=sums[1:])
        spot = np.arange(n - gram + 1, dtype=np.uint64)
        order = (mixed((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1]) & ~_LOW) | spot
        # the least of each window, from the least up to and from the borders of blocks as long as a window
        blocks = np.concatenate([order, np.full(-len(order) % window, ~np.uint64(0))]).reshape(-1, window)
        upto, behind = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - length + 1
        anchor = (np.minimum(behind[:starts], upto[window - 1 : window - 1 + starts]) & _LOW).astype(np.int64)
        level = (anchor - np.arange(starts)) // reach
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1])]))
        count = np.diff(np.append(first, starts))
        core, level = anchor[first] - level[first] * reach, level[first]
        hashed = lambda a, b: (sums[b] - sums[a]) * inverse[a]
        key = mixed(hashed(core, core + length - reach + 1) ^ mixed(level.astype(np.uint64)))
        content = mixed(hashed(first, first + count - 1 + length) + count.astype(np.uint64))
        found.append((first + at, count, key.view(np.int64), content.view(np.int64)))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)).cast(kind))


#: Rows that are looked at before they are handed on.
_ROWS = 256


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The rows, numbered, with their runs."""
    row = TaskContext.get().partitionId() << 40
    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(i, _ROWS)
            runs = [_runs(np.frombuffer(x, np.uint8), length) for x in batch["text"].to_pylist()]
            starts, counts, keys, contents = (list(x) for x in zip(*runs, strict=True))
            columns = [batch["id"], pa.array(row + np.arange(batch.num_rows)), batch["text"], _lists(starts, pa.int32()), _lists(counts, pa.int32()), _lists(keys, pa.int64()), _lists(contents, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "text", "starts", "counts", "cores", "contents"])
            row += batch.num_rows


def suffix_order(signs: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Places of all suffixes in order; ``signs`` are texts that end with 0 each, at ``ends`` of their places.

    A suffix goes to the end of its text; of equal ones the first comes first.
    Ranks by the first signs are doubled until they cover the longest text.
    """
    n = len(signs)
    place = np.arange(n)
    ahead = lambda values, k: np.where(place + k <= ends, values[np.minimum(place + k, n - 1)], 0)
    key, k = signs.astype(np.uint64), 1
    for i in (1, 2, 3):
        key = key << np.uint64(16) | ahead(signs, i).astype(np.uint64)
    k = 4
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        if k > longest or int(rank.max()) == n:
            return (np.sort(rank << np.uint64(32) | place.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key = rank << np.uint64(32) | ahead(rank, k).astype(np.uint64)
        k *= 2


def short_prefixes(bwt: np.ndarray, texts: int, length: int) -> np.ndarray:
    """For each place of a transform whether the prefix shared with the place before is shorter than ``length``.

    An interval is all suffixes that begin with one string. Put a sign before
    the string, and the interval of the longer one is found from where that
    sign stands in the transform. The place behind an interval that isn't told
    yet shares one sign less than the interval's string is long. Only such
    intervals go on, so each place is told once.
    """
    n = len(bwt)
    by_sign = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)
    to[by_sign] = np.arange(n)  # where the suffix with the sign before it stands
    same = bwt[by_sign[1:]] == bwt[by_sign[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[by_sign[1:][same]], after[by_sign[:-1][same]] = by_sign[:-1][same], by_sign[1:][same]
    told = np.zeros(n + 1, bool)
    told[: texts + 1] = told[n] = True
    edges = np.flatnonzero(~same) + 1  # where another sign begins
    edges = np.append(edges[edges >= texts], n)
    told[edges] = True
    left, right = np.concatenate([np.arange(texts), edges[:-1]]), np.concatenate([np.arange(texts), edges[1:] - 1])
    for _ in range(2, length + 1):
        sizes = right - left + 1
        own = np.repeat(np.arange(len(left)), sizes)
        at = np.arange(len(own)) + np.repeat(left - np.cumsum(sizes) + sizes, sizes)
        more = bwt[at] != 0  # nothing stands before a text
        lows = np.sort(to[at[more & (before[at] < left[own])]])
        highs = np.sort(to[at[more & (after[at] > right[own])]])
        new = ~told[highs + 1]
        left, right = lows[new], highs[new]
        told[right + 1] = True
        if not len(left):
            break
    return told


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some different texts at which of its starts a string stands that starts anywhere else in them."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    after = np.cumsum(sizes)
    signs = np.zeros(int(after[-1]), np.uint16)
    inside = np.ones(len(signs), bool)
    inside[after - 1] = False
    signs[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    order = suffix_order(signs, np.repeat(after - 1, sizes), int(sizes.max()))
    bwt = signs[order - 1]  # before the first place stands the last one, a 0 too
    short = short_prefixes(bwt, len(texts), length)
    found = np.zeros(len(signs), bool)
    found[order[~(short[:-1] & short[1:])]] = True
    return [found[b - n : b - length] for n, b in zip(sizes.tolist(), after.tolist(), strict=True)]


def _expand(block: pa.Table, length: int) -> pa.Table:
    """The marks of all runs of a block: a bit for each start."""
    found = repeated_starts(block["data"].to_pylist(), length)
    return pa.table({"core": block["core"], "content": block["content"], "marks": pa.array([np.packbits(x).tobytes() for x in found], pa.binary())})


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, dict]]:
    """(text, starts, counts, places of the runs asked for, what was asked) of each document."""
    for i, asked in enumerate(batch["asked"].to_pylist()):
        starts, counts, cores, contents = (batch[c][i].values.to_numpy() for c in ("starts", "counts", "cores", "contents"))
        place = {x: k for k, x in enumerate(zip(cores.tolist(), contents.tolist(), strict=True))}
        yield batch["text"][i].as_py(), starts, counts, np.array([place[x["core"], x["content"]] for x in asked], np.int64), asked


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that are asked for."""
    for batch in batches:
        out = [(x["block"], x["core"], x["content"], text[starts[k] : starts[k] + counts[k] - 1 + length]) for text, starts, counts, at, asked in _wanted(batch) for k, x in zip(at.tolist(), asked, strict=True)]
        for i in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 4096], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "core", "content", "data"])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of the runs that are asked for, by its digest, with the number of places where the run is."""
    for batch in batches:
        for text, starts, counts, at, asked in _wanted(batch):
            out = [(x["core"], x["content"], j, hashlib.blake2b(text[s : s + length], digest_size=16).digest(), x["times"]) for k, x in zip(at.tolist(), asked, strict=True) for j, s in enumerate(range(starts[k], starts[k] + counts[k]))]
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 4096], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["core", "content", "at", "digest", "times"])


def _remove(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The documents without what is marked in them. Marks: [run, a bit for each start]; no bits stand for all."""
    for batch in batches:
        rows = []
        for i, marked in enumerate(batch["marked"].to_pylist()):
            text = batch["text"][i].as_py()
            if not marked:
                rows.append((text, len(text), 0, 0))
                continue
            starts, counts = (batch[c][i].values.to_numpy() for c in ("starts", "counts"))
            change = np.zeros(len(text) + 1, np.int32)
            for m in marked:
                start, count = starts[m["run"]], counts[m["run"]]
                if m["marks"] is None:
                    change[start] += 1
                    change[start + count - 1 + length] -= 1
                else:
                    own = start + np.flatnonzero(np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=count))
                    change[own] += 1
                    np.subtract.at(change, own + length, 1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            rows.append((np.frombuffer(text, np.uint8)[~gone].tobytes(), len(text), int(np.count_nonzero(gone)), spans))
        kept, *numbers = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, core_runs: int = CORE_RUNS) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans.

    A byte goes if a string of ``length`` bytes that covers it starts at
    another place too, of any document or the same; strings are judged on the
    input and don't cross documents. Rows that repeat an id are documents of
    their own, null ids too, so a repeated long text goes whole, with all its
    copies. A null text is empty; texts shorter than ``length`` stay. What stays
    may cut a character of several bytes. An empty table gives an empty result;
    other columns of ``docs`` play no part, whatever their names.
    """
    if not 0 < length <= STEP:
        raise ValueError(f"length must be from 1 to {STEP}")
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary").alias("text"))
    kind, arrays = rows.schema["id"].dataType.simpleString(), "starts array<int>, counts array<int>, cores array<long>, contents array<long>"
    told = mapped(rows, functools.partial(_scan, length=length), f"id {kind}, row long, text binary, {arrays}", "op12-documents")

    # what can repeat: cores that occur twice; "one" are those whose runs are all equal
    runs = told.select("row", F.posexplode(F.arrays_zip("cores", "contents"))).select("row", F.col("pos").alias("run"), "col.cores", "col.contents").withColumnsRenamed({"cores": "core", "contents": "content"})
    counted = runs.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    # written, so that the join by a core that may be hot deals out both its sides
    counted = written(counted.select("core", (F.col("lo") == F.col("hi")).alias("one")), "op12-cores", narrow=True)
    again = written(runs.join(counted, "core"), "op12-runs")

    # different runs of one core, each once, with the number of its places and a document that has it
    several = again.where("not one").groupBy("core", "content").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("row"))
    cores = several.groupBy("core").agg(F.count(F.lit(1)).alias("different"), F.count(F.when(F.col("times") == 1, 1)).alias("open")).where("open > 0")
    several = written(several.join(cores.drop("open"), "core"), "op12-different", narrow=True)
    many = F.col("different") > core_runs
    total = several.agg(F.count(F.when(~many, 1)).alias("few"), F.count(F.when(many, 1)).alias("many")).first()
    blocks = 1 + total["few"] * (length + _shape(length)[1]) // block_bytes
    texts = told.select("row", "text", "starts", "counts", "cores", "contents")

    def asked(which: DataFrame) -> DataFrame:
        """The documents that have the runs; each has as many as it has at most."""
        block = F.pmod(F.xxhash64("core"), F.lit(blocks)).alias("block")
        own = which.groupBy("row").agg(F.collect_list(F.struct("core", "content", "times", block)).alias("asked"))
        return texts.join(own.hint("shuffle_hash"), "row").select("text", "starts", "counts", "cores", "contents", "asked")

    def expand(block: pa.Table) -> pa.Table:
        return _expand(block, length)

    found = "core long, content long, marks binary"
    marks = asked(several.where(~many)).mapInArrow(functools.partial(_cut, length=length), "block long, core long, content long, data binary").groupBy("block").applyInArrow(expand, found)
    if total["many"]:
        strings = written(asked(several.where(many)).mapInArrow(functools.partial(_strings, length=length), "core long, content long, at int, digest binary, times long"), "op12-strings")
        twice = strings.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest")
        flags = strings.join(twice, "digest", "left_semi").groupBy("core", "content").agg(F.array_sort(F.collect_set("at")).alias("at"))
        bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((_shape(length)[1] + 7) // 8 * 8 - 1)), lambda j: F.when(F.array_contains("at", j), "1").otherwise("0")), "")
        octets = F.transform(F.sequence(F.lit(0), F.lit((_shape(length)[1] + 7) // 8 - 1)), lambda i: F.lpad(F.conv(F.substr(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
        marks = marks.unionByName(flags.select("core", "content", F.unhex(F.array_join(octets, "")).alias("marks")))
    # runs that are at several places are marked whole; of the others what the blocks have found
    whole = F.lit(None).cast("binary").alias("marks")
    single = several.where("times = 1").select("core", "content").join(marks, ["core", "content"])
    single = written(single.where(F.col("marks") != F.unhex(F.repeat(F.lit("00"), F.octet_length("marks")))), "op12-marks")
    open_ = again.where("not one").select("row", "run", "core", "content")
    repeated = open_.groupBy("core", "content").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("core", "content")
    repeated = written(repeated, "op12-repeated", narrow=True)
    marked = again.where("one").select("row", "run", whole).unionByName(open_.join(repeated, ["core", "content"], "left_semi").select("row", "run", whole)).unionByName(open_.join(single, ["core", "content"]).select("row", "run", "marks"))
    by_row = marked.groupBy("row").agg(F.collect_list(F.struct("run", "marks")).alias("marked"))
    ready = told.select("id", "row", "text", "starts", "counts").join(by_row.hint("shuffle_hash"), "row", "left").drop("row")
    return ready.mapInArrow(functools.partial(_remove, length=length), f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
