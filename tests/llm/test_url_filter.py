import fnmatch
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.url_filter import DEFAULT, RULES, GlobAutomaton, judge_urls

GLOBS = st.lists(st.text("ab*", max_size=40), max_size=8)


@given(GLOBS, st.lists(st.text("abc", max_size=50), max_size=20))
@settings(max_examples=150, deadline=None)
def test_automaton_against_fnmatch(globs, texts):
    own = [[None if c == "*" else ord(c) for c in g] for g in globs]
    got = GlobAutomaton(own).match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            if g.replace("*", ""):
                assert got[i, j] == fnmatch.fnmatchcase(t, g), (t, g)


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else DEFAULT


def test_against_brute_force(spark):
    urls = [None, "", "x", "http://com/en/", "http://COM/en/7", "https://www.Example.com/en/71?x#y", "http://example.com/en/8", "http://notexample.com/en/7", "ftp://a.net/de/9", "http://example.net/de/8", "http://example.net/de/9", "http://x.org/es/#q", "http://x.org/es", "http://x.org?/es/", "http://a.info/x.com/en/", "http://a.info/\n.com/en/", "http://É.com/en/ü", "http://a://com/en/", "http://com/en/" + "z" * 100_000]
    rows = [(i if i % 5 else None, u, "h", "p", "r") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, id string")
    got = sorted(map(tuple, judge_urls(pages).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert judge_urls(pages.limit(0)).collect() == []
    assert {r.verdict for r in judge_urls(pages, rules=(), default="block").collect()} == {"block"}
