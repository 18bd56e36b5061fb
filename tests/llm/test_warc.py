import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from plumbline.llm.warc import READ_BYTES, WarcError, page_record, read_archives, read_records, write_archives


def test_members_and_frames():
    import random

    big = random.Random(1).randbytes(2 * READ_BYTES).hex().encode()
    raw = page_record(1, "http://a/\r\nX: y", b"<p>\r\n\r\n</p>") + page_record(2, None, big) + page_record(3, "u", big, 2, True) + page_record(None, "", b"")
    got = list(read_records(io.BytesIO(raw)))
    assert [r.kind for r in got] == ["response", "response", "revisit", "response"]
    assert [r.payload for r in got] == [b"<p>\r\n\r\n</p>", big, b"", b""]
    assert "x" not in got[0].headers and got[2].http["content-length"] == str(len(big))
    assert list(read_records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("broken", [lambda x: x[:-5], lambda x: x + b"junk", lambda x: gzip.compress(gzip.decompress(x)[:-1]), lambda x: gzip.compress(gzip.decompress(x).replace(b"page", b"pagf")), lambda x: gzip.compress(gzip.decompress(x).replace(b"Content-Length: 8", b"Content-Length: x")), lambda x: gzip.compress(b"no record")])
def test_damage_is_found(broken):
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(broken(page_record(1, "u", b"page")))))


COLUMNS = "page_id long, url string, html string, sha string, id long, revisit string"


def test_against_brute_force(spark):
    rows = [(i, f"http://x/{i}", "same" * 300, "s", 1, None) for i in range(40)]
    rows += [(100, "u", "a" * 999, None, None, None), (101, "u", "a" * 999, None, None, None), (102, "u", "é" * 500, None, None, None), (103, None, "é" * 500, None, None, None), (104, "u", None, None, None, None), (105, "u", "", None, None, None), (None, "u", "same" * 300, None, None, None), (None, "u", "lost" * 300, None, None, None), (None, "u", "lost" * 300, None, None, None), (39, "again", "same" * 300, None, None, None), (106, "u", "x" * 2_000_000, None, None, None)]
    pages = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = read_archives(write_archives(pages)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r[0])
    want = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        largest = max((x for x in groups[html or ""] if x is not None), default=None)
        revisit = len(raw) >= 1000 and len(groups[html or ""]) > 1 and largest is not None and page_id != largest
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    texts = {r.payload_digest: r.html for r in got if r.html is not None}
    assert {hashlib.sha1(t.encode()).hexdigest(): t for t in texts.values()} == texts
    assert read_archives(write_archives(pages.limit(0))).collect() == []
