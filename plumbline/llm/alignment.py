"""Alignment of the tokens of two vocabularies over a corpus, scored by how often ids meet.

Both vocabularies encode each text, and where tokens of both end at the same
byte the text falls into groups. Such an end links the two tokens that end
there. How often a pair of ids is linked is counted in dense matrices, striped
by the id of the second vocabulary (``STRIPE`` ids each):

1. Each task adds up its links by pair of ids and sends one row for each stripe
   that it met, salted, so that a common id's stripe is many tasks' work.
2. A task with a share of a stripe adds it into the stripe's block by
   ``np.add.at``; the shares' sums meet in one block a stripe, whose row maxima
   are the best counts. What has been counted goes to a file of the stripe.
3. Links, packed by batch and stripe, are dealt by the same stripes and salts;
   a task loads a stripe's block and scores all links of its share against it.
   Scores are summed by batch, and joined to the documents.

No row stands for a single link: what is shuffled are arrays of links and of
scores. A task holds one block (``STRIPE`` rows of the first vocabulary's size).
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.encoder import _byte_sign, encoder
from plumbline.llm.encoder import forget as forget_encoder
from plumbline.llm.shared import files_of, holding, mapped, new_folder, partitions, put_file, quoted, text_batches

#: Ids of the second vocabulary in a block of counts.
STRIPE = 256
#: Documents whose links are packed together.
BATCH_DOCS = 512
BLANK = "▁"


class PieceEncoder:
    """Ids by a piece model, as raw 32-bit integers, and the bytes that they stand for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.raw.append(piece.replace(BLANK, " ").encode())

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


class Tables:
    """What both sides' ids stand for: their bytes and how many, and their decimals with the sign that follows them."""

    def __init__(self, a_path: str, b_path: str):
        library, own = encoder(a_path, True).library, {_byte_sign(b): b for b in range(256)}
        raw_a = [bytes(own[c] for c in token) if (token := library.id_to_token(i)) and all(c in own for c in token) else (token or "").encode() for i in range(library.get_vocab_size())]
        self.raw = tuple(np.array([*x, None], object)[:-1] for x in (raw_a, piece_encoder(b_path).raw))
        self.sizes = tuple(np.array([len(x) for x in raw], np.int64) for raw in self.raw)
        # "12," and "12|" for the one side, "12," and "12;" for the other, and plain at the very end
        self.shown = tuple(np.array([*(f"{i}{end}" for end in ends for i in range(len(x))), None], object)[:-1] for x, ends in ((raw_a, ",|"), (self.raw[1], ",;")))

    def align(self, text: str, raw_a: bytes, raw_b: bytes) -> tuple[np.ndarray, np.ndarray, str] | None:
        """(ids of A, ids of B at common ends, the groups), or nothing if one side doesn't spell the text."""
        ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in (raw_a, raw_b)]
        want = b" " + text.encode()
        if any(b"".join(self.raw[k][ids[k]].tolist()) != want for k in (0, 1)):
            return None
        a, b = ids
        end_a, end_b = (np.cumsum(self.sizes[k][ids[k]]) for k in (0, 1))
        at = np.searchsorted(end_b, end_a)  # the last byte is an end of both
        closes_a = end_b[at] == end_a
        closes_b = np.zeros(len(b), bool)
        closes_b[at[closes_a]] = True
        last_a, last_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = self.shown[0][a + len(self.raw[0]) * closes_a]
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = self.shown[1][b + len(self.raw[1]) * closes_b]
        return a[last_a], b[last_b], "".join(out.tolist())[:-1]


@functools.lru_cache(maxsize=1)
def _tables(a_path: str, b_path: str) -> Tables:
    return Tables(a_path, b_path)


def forget() -> None:
    _tables.cache_clear()
    piece_encoder.cache_clear()
    forget_encoder()


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


@holding(forget)
def _align(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """A row per document: its counts and groups, its distinct pairs (b << 32 | a) with their numbers, and its batch."""
    tables, one, other = _tables(a_path, b_path), encoder(a_path, True), piece_encoder(b_path)
    part, number = TaskContext.get().partitionId(), 0
    names = ["id", "batch", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH_DOCS):
            batch = whole.slice(i, BATCH_DOCS)
            texts = [t or "" for t in batch["text"].to_pylist()]
            rows = []
            for text, raw_a, raw_b in zip(texts, one.encode([" " + t if t else "" for t in texts]), other.encode(texts), strict=True):
                found = tables.align(text, raw_a, raw_b) if text else None
                if found is None:
                    rows.append((0, 0, 0, 0, "", b"", b""))
                    continue
                a, b, groups = found
                pairs, counts = np.unique(b << 32 | a, return_counts=True)
                rows.append((len(raw_a) // 4, len(raw_b) // 4, len(a), len(a), hashlib.sha256(groups.encode()).hexdigest(), _packed(pairs, "<i8"), _packed(counts, "<u4")))
            n, columns = len(rows), zip(*rows, strict=True)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            head = [batch["id"], pa.array(np.full(n, (part << 32) + number)), pa.array(np.arange(n, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)
            number += 1


def _runs(stripe: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(stripe, its rows) of stripes in order."""
    cuts = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1], [True]])) if len(stripe) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(stripe[a]), slice(a, b)


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, place of the document, pair, number) of all links of each batch of documents that a task reads, in order of pairs."""
    for rows in batches:
        own = rows["batch"].to_numpy()
        for number, at in _runs(own):
            part = rows.slice(at.start, at.stop - at.start)
            pairs = [np.frombuffer(x, "<i8") for x in part["pairs"].to_pylist()]
            place = np.repeat(part["place"].to_numpy(), [len(x) for x in pairs])
            pair, count = np.concatenate(pairs), np.frombuffer(b"".join(part["counts"].to_pylist()), "<u4").astype(np.int64)
            order = np.argsort(pair, kind="stable")
            yield number, place[order], pair[order], count[order]


def _rows(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


_COUNTED = [("stripe", pa.int32()), ("salt", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())]
_LINKED = [("stripe", pa.int32()), ("salt", pa.int32()), ("batch", pa.int64()), ("places", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())]
_SCORED = [("batch", pa.int64()), ("places", pa.binary()), ("best", pa.binary()), ("sums", pa.binary())]


def _sums(pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ordered ones, with the sums of their counts."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    return pair[first], np.add.reduceat(count, first) if len(first) else count


def _send_counts(batches: Iterator[pa.RecordBatch], stripe: int, salts: int) -> Iterator[pa.RecordBatch]:
    for number, _, pair, count in _by_batch(batches):
        pair, count = _sums(pair, count)
        yield _rows([(k, number % salts, _packed(pair[at], "<i8"), _packed(count[at], "<i8")) for k, at in _runs((pair >> 32) // stripe)], _COUNTED)


def _send_links(batches: Iterator[pa.RecordBatch], stripe: int, salts: int) -> Iterator[pa.RecordBatch]:
    for number, place, pair, count in _by_batch(batches):
        yield _rows([(k, number % salts, number, _packed(place[at], "<u2"), _packed(pair[at], "<i8"), _packed(count[at], "<u4")) for k, at in _runs((pair >> 32) // stripe)], _LINKED)


class _Block:
    """The counts of a stripe's ids with all ids of the other side: a dense matrix, filled by ``np.add.at``."""

    def __init__(self, stripe: int, width: int):
        self.stripe, self.width, self.counts = stripe, width, np.zeros((stripe, width), np.int64)

    def place(self, k: int, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (pair >> 32) - k * self.stripe, pair & 0xFFFFFFFF

    def take(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that were counted and their counts; the block is empty then."""
        b, a = np.nonzero(self.counts)
        out = ((b + k * self.stripe) << 32 | a, self.counts[b, a])
        self.counts = np.zeros_like(self.counts)  # pages that weren't met cost nothing
        return out


def _add_up(batches: Iterator[pa.RecordBatch], stripe: int, width: int, done: Callable[[int, np.ndarray, np.ndarray], tuple]) -> Iterator[pa.RecordBatch]:
    """The sums of each stripe of a task, whose rows come stripe by stripe."""
    block, now = _Block(stripe, width), None
    for rows in batches:
        for k, pairs, counts in zip(*(rows[c].to_pylist() for c in ("stripe", "pairs", "counts")), strict=True):
            if now is not None and k != now:
                yield _rows([done(now, *block.take(now))], _COUNTED)
            now = k
            np.add.at(block.counts, block.place(k, np.frombuffer(pairs, "<i8")), np.frombuffer(counts, "<i8"))
    if now is not None:
        yield _rows([done(now, *block.take(now))], _COUNTED)


def _share(k: int, pair: np.ndarray, count: np.ndarray) -> tuple:
    return k, 0, _packed(pair, "<i8"), _packed(count, "<i8")


def _keep(k: int, pair: np.ndarray, count: np.ndarray, folder: str) -> tuple:
    """Puts the counts of a whole stripe into its file."""
    out = io.BytesIO()
    np.savez(out, pair=pair, count=count)
    put_file(f"{folder}/{k}", "counts", out.getvalue())
    return k, 0, None, None


def _score(batches: Iterator[pa.RecordBatch], folder: str, stripe: int, width: int) -> Iterator[pa.RecordBatch]:
    """For each batch of documents of a stripe: by document how many links are best ones, and the sum of their counts."""
    block, now, best = _Block(stripe, width), None, np.zeros(stripe, np.int64)
    for rows in batches:
        out = []
        for k, number, places, pairs, counts in zip(*(rows[c].to_pylist() for c in ("stripe", "batch", "places", "pairs", "counts")), strict=True):
            if k != now:
                known = np.load(io.BytesIO(files_of(f"{folder}/{k}")["counts"]))
                block.take(k)
                b, a = block.place(k, known["pair"])
                np.add.at(block.counts, (b, a), known["count"])
                best[:] = 0
                np.maximum.at(best, b, known["count"])  # the row maxima
                now = k
            b, a = block.place(k, np.frombuffer(pairs, "<i8"))
            place, times, found = np.frombuffer(places, "<u2"), np.frombuffer(counts, "<u4").astype(np.int64), block.counts[b, a]
            distinct, at = np.unique(place, return_inverse=True)
            n_best, total = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            np.add.at(n_best, at, times * (found == best[b]))
            np.add.at(total, at, times * found)
            out.append((number, distinct.tobytes(), _packed(n_best, "<u4"), _packed(total, "<i8")))
        yield _rows(out, _SCORED)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each batch of documents, whose rows come batch by batch."""
    sums, now = np.zeros((2, BATCH_DOCS), np.int64), None

    def done() -> pa.RecordBatch:
        met = np.flatnonzero(sums.any(axis=0))
        out = pa.RecordBatch.from_pydict({"batch": np.full(len(met), now), "place": met.astype(np.int32), "n_best": sums[0][met], "count_sum": sums[1][met]})
        sums[:] = 0
        return out

    for rows in batches:
        for number, places, best, total in zip(*(rows[c].to_pylist() for c in ("batch", "places", "best", "sums")), strict=True):
            if now is not None and number != now:
                yield done()
            now = number
            place = np.frombuffer(places, "<u2")
            sums[0][place] += np.frombuffer(best, "<u4")
            sums[1][place] += np.frombuffer(total, "<i8")
    if now is not None:
        yield done()


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", stripe: int = STRIPE, salts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, which gets
    a blank before the text, ``b_path`` a piece model, which puts one there.
    Strings of special tokens are ordinary text. A text that is null or empty,
    or that one side doesn't spell byte by byte, has no tokens: zeros, and no
    groups. Each of several rows with the same id, null ids too, is a document of
    its own. An empty table gives an empty result; other columns of ``docs``
    play no part, whatever their names.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    kind, folder = rows.schema["id"].dataType.simpleString(), new_folder(spark, "op13-counts")
    schema = f"id {kind}, batch long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
    told = mapped(rows, functools.partial(_align, a_path=a_path, b_path=b_path), schema, "op13-documents")

    from tokenizers import Tokenizer

    width, n = Tokenizer.from_file(a_path).get_vocab_size(), partitions(spark)
    salts = salts or max(4, n // 8)
    links = told.where("n_links > 0").select("batch", "place", "pairs", "counts")
    counted = ", ".join(("stripe int", "salt int", "pairs binary", "counts binary"))
    shares = links.mapInArrow(functools.partial(_send_counts, stripe=stripe, salts=salts), counted).repartition("stripe", "salt").sortWithinPartitions("stripe")
    sums = shares.mapInArrow(functools.partial(_add_up, stripe=stripe, width=width, done=_share), counted).repartition("stripe").sortWithinPartitions("stripe")
    kept = sums.mapInArrow(functools.partial(_add_up, stripe=stripe, width=width, done=functools.partial(_keep, folder=folder)), counted)
    kept.agg(F.count(F.lit(1))).first()

    dealt = links.mapInArrow(functools.partial(_send_links, stripe=stripe, salts=salts), "stripe int, salt int, batch long, places binary, pairs binary, counts binary").repartition("stripe", "salt").sortWithinPartitions("stripe")
    scored = dealt.mapInArrow(functools.partial(_score, folder=folder, stripe=stripe, width=width), "batch long, places binary, best binary, sums binary")
    totals = scored.repartition("batch").sortWithinPartitions("batch").mapInArrow(_total, "batch long, place int, n_best long, count_sum long")
    columns = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return told.drop("pairs", "counts").join(totals, ["batch", "place"], "left").select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", *columns, "groups_sha256")
