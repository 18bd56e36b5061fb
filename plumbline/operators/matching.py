"""One-to-one matching of two strata on the size of the logit of price, within a caliper."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALIPER = 0.10


class Free:
    """The places of ``high`` that aren't taken yet, as two linked lists over the sorted side, so a search skips what is taken."""

    def __init__(self, high: np.ndarray, caliper: float):
        self.order = np.argsort(high, kind="stable")
        self.sorted, self.caliper, n = high[self.order], caliper, len(high)
        # the next place that may be free: upwards from i is up[i], downwards from i is down[i + 1] - 1
        self.up, self.down = array("q", range(n + 1)), array("q", range(n + 1))
        self.values = array("d", self.sorted.tobytes())

    @staticmethod
    def _settle(links: array, at: int) -> int:
        root = at
        while links[root] != root:
            root = links[root]
        while links[at] != root:
            links[at], at = root, links[at]
        return root

    def take(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some of the low side in turn: which of them got a partner, and which of ``high`` it is."""
        values, up, down, n, own, partner = self.values, self.up, self.down, len(self.values), array("q"), array("q")
        for i, (x, at) in enumerate(zip(low.tolist(), np.searchsorted(self.sorted, low).tolist(), strict=True)):
            above, below = self._settle(up, at), self._settle(down, at) - 1
            found = []
            if above < n:
                found.append((abs(values[above] - x), above - at, 0, above))
            if below >= 0:
                found.append((abs(values[below] - x), at - 1 - below, 1, below))
            if found and (best := min(found))[0] <= self.caliper:
                place = best[3]
                up[place], down[place + 1] = place + 1, place
                own.append(i)
                partner.append(place)
        return np.array(own, np.int64), self.order[np.array(partner, np.int64)]


def match(low: np.ndarray, high: np.ndarray, caliper: float = CALIPER) -> list[tuple[int, int]]:
    """Greedy: in the order given each of ``low`` takes the nearest of ``high`` that is free, if near enough.

    Of two equally near the one fewer places away in the order of ``high``, and
    then the larger, is taken.
    """
    own, partner = Free(np.asarray(high, float), caliper).take(np.asarray(low, float))
    return list(zip(own.tolist(), partner.tolist(), strict=True))


def _runs(batch: pa.RecordBatch, groups: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch that are of one group each, with the group's values."""
    codes = [pc.dictionary_encode(batch[c], null_encoding="encode").indices.to_numpy() for c in groups]
    new = functools.reduce(np.logical_or, (c[1:] != c[:-1] for c in codes), np.zeros(max(0, batch.num_rows - 1), bool))
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield tuple(batch[c][a].as_py() for c in groups), batch.slice(a, b - a)


def _pairs(batches: Iterator[pa.RecordBatch], groups: Sequence[str], caliper: float) -> Iterator[pa.RecordBatch]:
    """Pairs from rows sorted by group, the high side first. Held of a group are the logits and keys of its high side."""
    group, held, free, keys, x_high = None, [], None, None, None
    for batch in batches:
        for own, part in _runs(batch, groups):
            if repr(own) != group:
                group, held, free = repr(own), [], None
            q = np.clip(part["__p"].to_numpy(), 1e-6, 1 - 1e-6)
            x, low = np.abs(np.log(q / (1 - q))), part["__low"].to_numpy(zero_copy_only=False)
            n = int(np.count_nonzero(~low))
            if n:
                held.append((x[:n], part["__key"].slice(0, n)))
            if n == part.num_rows:
                continue
            if free is None:
                x_high = np.concatenate([v for v, _ in held]) if held else np.zeros(0)
                keys = pa.concat_arrays([k for _, k in held]) if held else part["__key"].slice(0, 0)
                free, held = Free(x_high, caliper), []
            lows, partners = free.take(x[n:])
            at = pa.array(lows + n)
            pairs = [*(part[c].take(at) for c in groups), part["__key"].take(at), keys.take(pa.array(partners)), pa.array(np.abs(x[n:][lows] - x_high[partners]))]
            yield pa.RecordBatch.from_arrays(pairs, names=[*groups, "low_key", "high_key", "distance"])


def caliper_match(df: DataFrame, by: Sequence[str], level: str, low: str, high: str, key: str, p: str = "p", caliper: float = CALIPER, order: Sequence[str] = ()) -> DataFrame:
    """Pairs (low_key, high_key, distance) within each group, matched on the distance of the price from even: |logit p|.

    The low side takes its partners in order of ``order`` and key. Greedy
    matching is sequential, so a group is a task's; Spark sorts it, and the task
    meets the low side batch by batch and holds a few numbers for each of the high.
    """
    groups = [f"__b{i}" for i in range(len(by))]
    price = F.col(p).cast("double")
    rows = df.where(F.col(level).isin(low, high) & price.isNotNull() & ~F.isnan(price))
    turns = [f"__o{i}" for i in range(len(order))]
    rows = rows.select(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), *(F.col(c).alias(o) for c, o in zip(order, turns, strict=True)), F.col(key).alias("__key"), price.alias("__p"), (F.col(level) == low).alias("__low"))
    sorted_ = (rows.repartition(*groups) if groups else rows.coalesce(1)).sortWithinPartitions(*groups, "__low", *(F.col(c).asc_nulls_last() for c in (*turns, "__key")))
    kind = df.schema[key].dataType
    schema = rows.select(*groups).schema.add("low_key", kind).add("high_key", kind).add("distance", "double")
    pairs = sorted_.select(*groups, "__key", "__p", "__low").mapInArrow(functools.partial(_pairs, groups=groups, caliper=caliper), schema)
    return pairs.select(*(F.col(g).alias(c) for c, g in zip(by, groups, strict=True)), "low_key", "high_key", "distance")
