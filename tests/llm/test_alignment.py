"""Alignment of two vocabularies (op13) against a plain version with the libraries themselves."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm.alignment import align_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the cat sat on the mat", "the cat sat on the mat", "Der Hund, die Katze; das Haus.", "", None, " ", "  two  blanks ", "\n\n a\tb\r\n", "<s> </s> <unk> <0x41> <|endoftext|>", "a ▁ sign", "漢字 かな 🙂 é́", "\x00 nul",
    "naïve Straße Ωμέγα", "the " * 3000, "the, the. the; 1234567 the", "x" * 500,
]
ROWS = [(i, x, 3, "pair") for i, x in enumerate(TEXTS)] + [(None, "the cat", None, None), (2, "again the cat", 1, None), (2, "again the cat", 1, None), (-4, "below the", 0, "x")]
SCHEMA = "doc_id long, text string, batch int, pairs string"


def plain(rows):
    one, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    sign = {c: b for b, c in enumerate(_signs())}
    found, count = [], Counter()
    for doc_id, text, *_ in rows:
        links, groups, a, b = [], "", [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
            raw_a = [bytes(sign[c] for c in one.id_to_token(i)) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if other.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [other.id_to_piece(i)]]
            if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
                a, b = [], []
            parts, i, j, x, y = [], 0, 0, 0, 0
            own_a, own_b = [], []
            while i < len(a) or j < len(b):
                if x <= y and i < len(a) and not (x == y and len(own_a) > len(own_b)):
                    own_a.append(a[i])
                    x += len(raw_a[i])
                    i += 1
                else:
                    own_b.append(b[j])
                    y += len(raw_b[j])
                    j += 1
                if x == y and own_a and own_b:
                    parts.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                    links.append((own_a[-1], own_b[-1]))
                    own_a, own_b = [], []
            groups = ";".join(parts)
        count.update(links)
        found.append((doc_id, len(a), len(b), links, groups))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if links else "") for d, n_a, n_b, links, groups in found]


def _signs():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@pytest.mark.parametrize(("stripe", "salts"), [(256, None), (64, 1)])
def test_as_the_plain_version(spark, stripe, salts):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted(map(tuple, align_tokens(docs, A, B, stripe=stripe, salts=salts).collect()), key=str)
    want = sorted(plain(ROWS), key=str)
    assert got == want


def test_whole_documents_of_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, align_tokens(docs, A, B).collect()))
    assert got == sorted(plain(rows))
    assert 0 < sum(x[5] for x in got) < sum(x[4] for x in got)


def test_empty_table_and_odd_names(spark):
    assert align_tokens(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    docs = spark.createDataFrame([("k", "one two")], "`i.d` string, `te``xt` string")
    got = align_tokens(docs, A, B, id_col="i.d", text_col="te`xt").collect()
    assert [tuple(r) for r in got] == plain([("k", "one two")])
