"""Language identification by hierarchical discrimination.

First the language family is predicted, by one linear support vector machine
against the rest for each family. Then, within the family only, one-versus-one
machines separate its languages, each pair by a machine of its own, and vote.
All work on the same features: hashed byte trigrams of the whole lower-cased
text, as shares of all its trigrams. A machine's value is so the mean of one
table entry per trigram, which is looked up for many texts at once.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import quoted, text_batches

#: Families of languages by ISO code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc ast la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo_aryan": "hi bn ur mr gu pa ne si",
    "semitic": "ar he mt am",
    "malayo_polynesian": "id ms tl jv",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
UNDETERMINED = "und"
#: Hashed features; labelled texts of a language that the machines are fitted on, at most; passes over them.
FEATURE_BITS, SAMPLE_TEXTS, PASSES, PENALTY = 15, 600, 12, 1e-3
#: Bytes of text whose trigrams are looked up at a time.
BLOCK_BYTES = 1 << 19


class Machine(NamedTuple):
    """``positive`` against ``negative``; a value above 0 speaks for the first."""

    positive: str
    negative: str
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    families: dict[str, list[str]]
    by_family: list[Machine]
    by_pair: list[Machine]


def trigrams(data: np.ndarray) -> np.ndarray:
    """The hashed feature of each byte trigram."""
    a = data.astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int32)


def _bytes(text: str) -> bytes:
    return b" " + text.encode().lower() + b" "


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, places, shares) of each text."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            rows, places, shares = batch.slice(i, 64), [], []
            for text in rows["text"].to_pylist():
                found, count = np.unique(trigrams(np.frombuffer(_bytes(text), np.uint8)), return_counts=True)
                places.append(found)
                shares.append((count / count.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([rows["lang"], pa.array(places, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "places", "shares"])


def _machine(positive: str, negative: str, rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, scale: float) -> Machine:
    """Linear support vector machine by dual coordinate descent, each side weighed by the size of the other."""
    n, w, b = len(rows), np.zeros(1 << FEATURE_BITS), 0.0
    share = np.where(signs > 0, (signs < 0).sum(), (signs > 0).sum()) / n * 2
    most, dual = share / (PENALTY * n), np.zeros(n)
    norm = np.array([float(x @ x) for _, x in rows]) * scale * scale + 1.0
    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in rng.permutation(n):
            at, x = rows[i]
            gradient = signs[i] * (float(w[at] @ x) * scale + b) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), most[i])
            if (step := (new - dual[i]) * signs[i]) != 0:
                w[at] += step * scale * x
                b += step
                dual[i] = new
    return Machine(positive, negative, (w * scale).astype(np.float32), b)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fits on at most ``sample_texts`` distinct texts of each language, chosen by a hash of the text.

    Copies of a text under one language count once. Rows without a language, text or letter teach nothing. Without any, the
    model knows no language. The driver gets sparse features of the sample only.
    """
    rows = labelled.select(F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang")).where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    rows = rows.withColumn("hash", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, [], [])
    # a share of each language by the hash, generous, then the exact number; texts that don't come in are not shuffled
    shares = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, 1.5 * sample_texts / v + 20 / v))) for k, v in counts.items()))
    draw = F.pmod(F.col("hash"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < shares[F.col("lang")]).groupBy("lang", "hash", "draw").agg(F.min("text").alias("text"))
    ranked = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("n") <= sample_texts)
    found = ranked.select("lang", "text").mapInArrow(_features, "lang string, places array<int>, shares array<float>").toPandas()
    texts: dict[str, list] = defaultdict(list)
    for lang, at, x in zip(found["lang"], found["places"], found["shares"], strict=True):
        texts[lang].append((np.asarray(at), np.asarray(x, np.float64)))
    scale = 1 / max(1e-9, float(np.mean([np.sqrt(x @ x) for own in texts.values() for _, x in own])))
    families: dict[str, list[str]] = defaultdict(list)
    for lang in sorted(texts):
        families[FAMILY_OF.get(lang, lang)].append(lang)
    of = {f: [r for lang in langs for r in texts[lang]] for f, langs in families.items()}

    def against(positive: str, negative: str, yes: list, no: list) -> Machine:
        return _machine(positive, negative, yes + no, np.array([1.0] * len(yes) + [-1.0] * len(no)), scale)

    names = sorted(families)
    by_family = [against(f, "", of[f], [r for g in names if g != f for r in of[g]]) for f in names] if len(names) > 1 else []
    by_pair = [against(a, b, texts[a], texts[b]) for f in names for a, b in itertools.combinations(families[f], 2)]
    return Model(dict(families), by_family, by_pair)


def values(texts: list[str], machines: list[Machine]) -> np.ndarray:
    """A row for each text, a column for each machine; long texts are looked up in blocks."""
    weights = np.stack([m.weights for m in machines], axis=1)
    sums, sizes = np.zeros((len(texts), len(machines))), np.zeros(len(texts))
    held, owners, size = [], [], 0

    def settle() -> None:
        nonlocal held, owners, size
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            found = np.add.reduceat(weights[np.concatenate(held)], starts, axis=0, dtype=np.float64)
            np.add.at(sums, owners, found)
        held, owners, size = [], [], 0

    for i, text in enumerate(texts):
        data = np.frombuffer(_bytes(text), np.uint8)
        sizes[i] = len(data) - 2
        for at in range(0, len(data) - 2, BLOCK_BYTES):
            held.append(trigrams(data[at : at + BLOCK_BYTES + 2]))
            owners.append(i)
            size += len(held[-1])
            if size >= BLOCK_BYTES:
                settle()
    settle()
    return sums / sizes[:, None] + np.array([m.bias for m in machines])


def predict(texts: list[str], model: Model) -> list[tuple[str, float]]:
    """(language, score) of texts that have a letter."""
    if not model.families:
        return [(UNDETERMINED, 0.0)] * len(texts)
    machines = [*model.by_family, *model.by_pair]
    if not machines:
        return [(next(iter(model.families.values()))[0], 1.0)] * len(texts)
    sure = lambda v: 1 / (1 + np.exp(-np.clip(2 * v, -30, 30)))
    out = []
    for row in values(texts, machines):
        by_family, by_pair = row[: len(model.by_family)], row[len(model.by_family) :]
        family, score = next(iter(model.families)), 1.0
        if len(by_family):
            best = int(by_family.argmax())
            family, score = model.by_family[best].positive, float(sure(by_family[best] - np.delete(by_family, best).max()))
        votes: dict[str, list[float]] = {lang: [] for lang in model.families[family]}
        for m, v in zip(model.by_pair, by_pair, strict=True):
            if m.positive in votes:
                votes[m.positive].append(v)
                votes[m.negative].append(-v)
        lang = max(votes, key=lambda x: (sum(v > 0 for v in votes[x]), sum(votes[x])))
        out.append((lang, score * float(np.mean(sure(np.array(votes[lang])))) if votes[lang] else score))
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    import regex

    letter = regex.compile(r"\p{L}").search
    for batch in batches:
        texts = [t if t is not None and letter(t) else None for t in batch["__text"].to_pylist()]
        told = iter(predict([t for t in texts if t is not None], model))
        found = [(UNDETERMINED, 0.0) if t is None else next(told) for t in texts]
        keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__text"]
        names = [name for name in batch.schema.names if name != "__text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])


def held_out(id_col: str = "doc_id"):
    """Of a third of the documents: those that nothing is learned from. A null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1).

    A null text, or one without any letter, is ``und`` with score 0; so is every
    text if the model knows no language. Nothing but the text is looked at.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("__text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(functools.partial(_predict, model=model), schema)


def drop_undetermined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is ``und``: those of a null text or one without any letter.

    All other rows stay, with the columns they came with. What the model is
    fitted on is told by ``held_out``, and a row labelled ``und`` teaches nothing;
    the language that a row has is not changed. Where nothing can be learned from,
    all texts with a letter count as of one language.
    """
    model = fit(docs.where(~held_out(id_col) & (F.col(quoted(lang_col)) != UNDETERMINED)), text_col, lang_col)
    if not model.families:
        model = Model({"": [""]}, [], [])
    told = identify(docs.withColumn("__row", F.struct(*(F.col(quoted(c)) for c in docs.columns))), model, "__row", text_col)
    return told.where(F.col("lang_pred") != UNDETERMINED).select("doc_id.*")


def hierarchical_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the rows that aren't held out and have a language."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    found = identify(docs, model, id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
