"""URL rules as globs, simulated together by a multiword Shift-And automaton.

A canonical URL is the host behind a dot, a mark, and the path. A rule
(host, path) becomes the glob ``*.host<mark>path*``: the mark stands nowhere
else, so a rule can't match across host and path. All globs are packed one
after the other into 64-bit words, one bit for each literal; a ``*`` lets the
bit before it loop. One step advances every glob for every URL of a block:
shift with carry, mask by character, loop.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Between host and path; a byte that no UTF-8 text has.
MARK = b"\xff"
#: Bytes of URLs, padded to the longest, that are simulated at a time.
BLOCK_BYTES = 4_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of op10; DEFAULT is the verdict where none fits.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
DEFAULT = "allow"


class GlobAutomaton:
    """Byte globs, in which a ``None`` is a ``*``, packed into words of 64 bits.

    A glob without any literal fits everything.
    """

    def __init__(self, globs: Sequence[Sequence[int | None]]):
        literals = [[c for c in g if c is not None] for g in globs]
        total = sum(map(len, literals))
        self.words = max(1, -(-total // 64))
        self.by_byte = np.zeros((256, self.words), np.uint64)
        self.first, self.always, self.loops = (np.zeros(self.words, np.uint64) for _ in range(3))
        self.last: list[tuple[int, np.uint64] | None] = []
        place = 0
        for glob, own in zip(globs, literals, strict=True):
            if not own:
                self.last.append(None)
                continue
            bit = lambda i: (i // 64, np.uint64(1) << np.uint64(i % 64))
            w, b = bit(place)
            self.first[w] |= b
            if glob[0] is None:
                self.always[w] |= b
            at = place - 1
            for c in glob:
                if c is None:
                    if at >= place:
                        w, b = bit(at)
                        self.loops[w] |= b
                else:
                    at += 1
                    w, b = bit(at)
                    self.by_byte[c, w] |= b
            self.last.append(bit(at))
            place += len(own)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row for each text and a column for each glob: does it fit the whole text?"""
        out = np.zeros((len(texts), len(self.last)), bool)
        sizes = np.array([len(x) for x in texts], np.int64)
        order, start = np.argsort(-sizes, kind="stable"), 0
        while start < len(order):
            widest = max(1, int(sizes[order[start]]))
            block = order[start : start + max(1, BLOCK_BYTES // widest)]
            start += len(block)
            out[block] = self._block([texts[i] for i in block], sizes[block])
        return out

    def _block(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Texts from the longest to the shortest."""
        widest = int(sizes[0])
        flat = np.frombuffer(b"".join(x.ljust(widest, b"\0") for x in texts), np.uint8).reshape(len(texts), widest) if widest else np.zeros((len(texts), 0), np.uint8)
        state = np.zeros((len(texts), self.words), np.uint64)
        active = np.searchsorted(-sizes, -np.arange(widest), side="left")  # texts longer than t
        for t in range(widest):
            own = state[: active[t]]
            moved = own << np.uint64(1)
            moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            moved &= ~self.first
            moved |= self.first if t == 0 else self.always
            moved &= self.by_byte[flat[: active[t], t]]
            moved |= own & self.loops
            state[: active[t]] = moved
        return np.stack([np.ones(len(texts), bool) if x is None else (state[:, x[0]] & x[1]) != 0 for x in self.last], axis=1) if self.last else np.zeros((len(texts), 0), bool)


def rule_glob(rule: Rule) -> list[int | None]:
    """The rule's host with all its subdomains, and any path that starts with the rule's."""
    return [None, *b"." + rule.host.encode() + MARK + rule.path.encode(), None]


def _judge(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], default: str) -> Iterator[pa.RecordBatch]:
    automaton = GlobAutomaton([rule_glob(r) for r in rules])
    # the longest rule wins; of equally long ones that with the longer host, then the earlier one
    rank = np.array(sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), -len(rules[i].host), i)), np.int64)
    for batch in batches:
        hosts, paths = (batch[c].to_pylist() for c in ("host", "path"))
        fits = automaton.match([b"." + h.encode() + MARK + p.encode() for h, p in zip(hosts, paths, strict=True)])[:, rank]
        best = [int(rank[i]) if ok else None for i, ok in zip(fits.argmax(axis=1), fits.any(axis=1), strict=True)] if len(rules) else [None] * batch.num_rows
        rule = pa.array([None if b is None else rules[b].text for b in best], pa.string())
        verdict = pa.array([default if b is None else rules[b].verdict for b in best], pa.string())
        yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], rule, verdict], names=["id", "host", "path", "rule", "verdict"])


def canonical(url_col: str):
    """(host, path) of a URL: the host after the first ``://``, A-Z lower-cased; both empty without one."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest wins (then the longer host, then the earlier rule).
    Where none fits, ``rule`` is null and the verdict is ``default``. A null
    URL, or one without ``://``, has an empty host and path and so fits none.
    Null or repeated ids, other columns and empty tables pass as they are.
    """
    host, path = canonical(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return rows.mapInArrow(functools.partial(_judge, rules=tuple(rules), default=default), schema).withColumnRenamed("id", "page_id")
