"""Fill-in-the-middle transformation of documents, in native column expressions.

``regexp_extract_all`` cuts a text into its units, parts of the SHA-256 of the
document's key say where it is cut and how it is arranged, ``slice`` and
``array_join`` build the arrangement, and the sentinels are searched for to
get the text back. No Python runs on a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import quoted

#: A line with its end; the last may have none.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
PSM, SPM, PLAIN = "psm", "spm", "plain"


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """The three sentinels, if a parser can't take a part of one, or of two in a row, for another."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("there must be three different sentinels, none of them empty")
    for a in sentinels:
        for b in sentinels:
            if a != b and a in b or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    first, second, third = sentinels
    return first, second, third


def _number(digest: str, i: int) -> Column:
    """The i-th group of eight hexadecimal digits."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, unit: str = LINES, sentinels: Sequence[str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix, middle, suffix and output.

    The cuts fall between units, at two places drawn for the document; ``rate``
    percent of the documents are rearranged, ``spm_rate`` percent of those with
    the suffix first. Draws depend on seed and id alone, so rows that repeat an
    id with the same text are the same; a null id draws like an empty one.
    A null text is empty. Plain, with null parts, stay empty texts, those that
    hold a sentinel, and those that aren't drawn. A text that units don't cover
    whole is refused. An empty table gives an empty result; other columns of
    ``docs`` play no part, whatever their names.
    """
    p, s, m = _checked(sentinels)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(unit), F.lit(0)).alias("units"), drawn.alias("digest"))
    n = F.size("units").cast("long")
    at = [_number("digest", i) % (n + 1) for i in (0, 1)]
    held = F.lit(False)
    for x in (p, s, m):
        held = held | F.col("text").contains(F.lit(x))
    form = F.when((F.col("text") == "") | held | (_number("digest", 2) % 100 >= rate), PLAIN).when(_number("digest", 3) % 100 < spm_rate, SPM).otherwise(PSM)
    placed = cut.select("doc_id", "text", "units", n.alias("n"), F.least(*at).cast("int").alias("a"), F.greatest(*at).cast("int").alias("b"), form.alias("form"))
    part = lambda first, count: F.when(F.col("form") != PLAIN, F.array_join(F.slice("units", first + 1, count), ""))
    whole = F.when(F.length(F.array_join("units", "")) == F.length("text"), F.col("text")).otherwise(F.raise_error(F.lit("units don't cover a text")))
    text = F.col("text") if unit == LINES else whole
    parts = placed.select("doc_id", text.alias("text"), "n", "form", part(F.lit(0), F.col("a")).alias("prefix"), part(F.col("a"), F.col("b") - F.col("a")).alias("middle"), part(F.col("b"), F.size("units") - F.col("b")).alias("suffix"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == PLAIN, F.col("text")).when(F.col("form") == PSM, psm).otherwise(spm)
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: str = "output", form: str = "form", sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that was rearranged, from the output and its form alone. Null for a null output or form."""
    p, s, m = _checked(sentinels)
    out = F.col(quoted(output))
    before = lambda x, mark: F.substring_index(x, mark, 1)
    behind = lambda x, mark: F.substring_index(x, mark, -1)
    first_p, middle = before(behind(out, p), s), behind(out, m)
    psm = F.concat(first_p, middle, before(behind(out, s), m))
    spm = F.concat(before(behind(out, p), m), middle, before(behind(out, s), p))
    return F.when(F.col(quoted(form)) == PLAIN, out).when(F.col(quoted(form)) == PSM, psm).when(F.col(quoted(form)) == SPM, spm)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with its production parameters, told by lengths and SHA-256."""
    found = fill_in_middle(docs)
    return found.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
