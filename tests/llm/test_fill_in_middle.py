"""Fill-in-the-middle (op11) against a plain version, and its edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm.fill_in_middle import fill_in_middle, fill_in_middle_digests, restored

TEXTS = [
    "one\ntwo\nthree\n", "one\ntwo\nthree", "\n\n\n", "no end", "", None, "a <P> b\nc", "x\n<S>", "y<M>", "half <P\n>S> <", "ends with <\nand <S\n<P\n<", "é\U0001f642\n漢字\r\n\tz w\n",
    "long line " * 20_000, "line\n" * 30_000, "\x00\n\x00", "\n",
]
ROWS = [(i, x, "form", 3, "out") for i, x in enumerate(TEXTS)] + [(None, "a\nb\nc", "x", None, None), (3, "again\nand\nagain", None, 1, None), (3, "again\nand\nagain", None, 1, None), (-9, "below\nzero\n", None, 1, "y")]
SCHEMA = "doc_id long, text string, form string, n long, output string"


def plain(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_rate:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm_rate", "seed"), [(100, 50, 7), (40, 0, 3), (100, 100, 1), (0, 50, 7)])
def test_arranged_as_the_plain_version_and_restored(spark, rate, spm_rate, seed):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = fill_in_middle(docs, rate, spm_rate, seed).withColumn("back", restored())
    got = sorted(map(tuple, found.collect()), key=str)
    want = sorted([(r[0], *plain(r[0], r[1], rate, spm_rate, seed), r[1] or "") for r in ROWS], key=str)
    assert got == want
    if rate == 100 and spm_rate == 50:
        assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_digests_and_no_python_in_the_plan(spark):
    found = fill_in_middle_digests(spark.createDataFrame(ROWS, SCHEMA))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in ROWS:
        n, form, p, m, _, out = plain(doc_id, text)
        want.append((doc_id, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(text or "")))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_odd_names_other_sentinels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d <P>")], "`i.d` long, `te``xt` string")
    own = ("[pre]", "(suf)", "{mid}")
    found = fill_in_middle(docs, unit=r"[^ ]* |[^ ]+", sentinels=own, id_col="i.d", text_col="te`xt").withColumn("back", restored(sentinels=own))
    row = found.first()
    assert row["back"] == "a b c d <P>" and row["form"] != "plain" and row["n"] == 5
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, sentinels=("ab", "bc", "x"), id_col="i.d", text_col="te`xt")
    with pytest.raises(ValueError):
        fill_in_middle(docs, sentinels=("a", "ba", "x"), id_col="i.d", text_col="te`xt")
    with pytest.raises(Exception, match="cover"):
        fill_in_middle(docs, unit="[^ ]+", id_col="i.d", text_col="te`xt").where(F.length("output") > 0).collect()
