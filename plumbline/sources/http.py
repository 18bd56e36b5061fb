"""JSON over HTTP: paced, retried, checked for shape, cached; and as a Spark data source.

The transport is given, so that all of it runs on recorded answers.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from collections.abc import Callable, Iterator, Mapping
from email.utils import parsedate_to_datetime
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Requests a second, first and longest wait, failures in a row that open the circuit.
RATE, BACKOFF, LONGEST, BREAK_AFTER = 5.0, 2.0, 60.0, 5


class TransientError(RuntimeError):
    """May pass; never an answer."""


class NetworkUnavailable(TransientError):
    """All attempts failed."""


class CircuitOpen(TransientError):
    """Too many failures in a row; nothing is sent any more."""


class ShapeError(ValueError):
    """The answer isn't of the agreed shape."""


class StatusError(RuntimeError):
    """A status that no other attempt would change."""


class Answer(NamedTuple):
    status: int
    headers: Mapping[str, str]
    body: bytes


Transport = Callable[[str], Answer]


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds to wait by a header in seconds or as a date; none if it says neither."""
    if not value:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


class Cache:
    """Answers by a hash of their address, in folders by its first letters. What hangs on a mapping carries its fingerprint."""

    def __init__(self, root: str, mapping: str = "", schema: str = "1"):
        self.root, self.mapping, self.schema = root, mapping, schema

    def key(self, url: str) -> str:
        return hashlib.sha256("|".join([url, self.schema, self.mapping if "slug=" in url else ""]).encode()).hexdigest()

    def _path(self, url: str) -> str:
        k = self.key(url)
        return os.path.join(self.root, k[:2], k[2:4], f"{k}.json")

    def get(self, url: str):
        try:
            with open(self._path(url), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def put(self, url: str, value) -> None:
        """Empty answers aren't kept: they may fill."""
        if not value:
            return
        path = self._path(url)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, held = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f)
        os.replace(held, path)


class Client:
    def __init__(self, transport: Transport, cache: Cache | None = None, rate: float = RATE, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.cache, self.gap, self.clock, self.sleep = transport, cache, 1 / rate, clock, sleep
        self.next, self.failures = 0.0, 0

    def _pace(self) -> None:
        wait = self.next - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.next = max(self.clock(), self.next) + self.gap

    def get_json(self, url: str, attempts: int = 4, validator: Callable[[object], bool] = bool, fresh: bool = False):
        """The answer as JSON. ``validator`` raises ShapeError for another shape, of a cached answer too, and tells whether to cache.

        An answer of status 200 that isn't JSON is retried: it is a barrier page,
        never an answer. A 403 is retried too, but counts towards the circuit
        each time; other statuses than 429 and 502 to 504 count and raise.
        """
        if self.cache and not fresh and (held := self.cache.get(url)) is not None:
            validator(held)
            return held
        wait, unreachable, why = BACKOFF, 0, ""
        for attempt in range(attempts):
            if self.failures >= BREAK_AFTER:
                raise CircuitOpen(url)
            self._pace()
            try:
                answer = self.transport(url)
            except OSError as e:
                unreachable, why = unreachable + 1, str(e)
            else:
                headers = {k.lower(): v for k, v in answer.headers.items()}
                why = f"status {answer.status}"
                if answer.status == 200:
                    value, sound = self._parsed(answer, headers)
                    if sound:
                        self.failures = 0
                        if validator(value) and self.cache:
                            self.cache.put(url, value)
                        return value
                    why = "not JSON"
                elif answer.status in (403, 429, 502, 503, 504):
                    if asked := headers.get("retry-after"):
                        told = retry_after(asked, time.time())
                        wait = LONGEST if told is None else min(told, LONGEST)
                    if answer.status == 403:
                        self._count(url, why)
                else:
                    self._count(url, why)
                    raise StatusError(f"{url}: {why}")
            if attempt + 1 < attempts:
                self.sleep(wait)
                wait = min(2 * wait, LONGEST)
        if unreachable == attempts:
            raise NetworkUnavailable(f"{url}: {why}")
        self._count(url, why)
        raise TransientError(f"{url}: {why}")

    def _count(self, url: str, why: str) -> None:
        self.failures += 1
        if self.failures >= BREAK_AFTER:
            raise CircuitOpen(f"{url}: {why}, {self.failures} failures in a row")

    @staticmethod
    def _parsed(answer: Answer, headers: Mapping[str, str]) -> tuple[object, bool]:
        if "json" not in headers.get("content-type", "").lower():
            return None, False
        try:
            return json.loads(answer.body), True
        except ValueError:
            return None, False


def validate_history(value: object) -> bool:
    """``{"history": [{"t": ..., "p": ...}]}``."""
    if not isinstance(value, dict) or not isinstance(value.get("history"), list):
        raise ShapeError("no history")
    if not all(isinstance(x, dict) and "t" in x and "p" in x for x in value["history"]):
        raise ShapeError("a point lacks t or p")
    return bool(value["history"])


def validate_list(value: object) -> bool:
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise ShapeError("no list of objects")
    return bool(value)


class RecordedSource(DataSource):
    """Spark data source of recorded answers: a folder of JSON files, one partition each, read on the executors.

    ``spark.read.format("recorded").option("path", folder)`` gives address and body.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordedReader(self.options["path"])


class _RecordedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".json")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.value) as f:
            record = json.loads(f.read())
        yield record["url"], json.dumps(record["body"])
