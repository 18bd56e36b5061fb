import random
import zlib

from plumbline.llm.language_id import drop_undetermined, fit, hierarchical_language_id, identify

WORDS = {
    "en": "the of and that with this from have they will would there their what about which when make can like time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us".split(),
    "de": "der die und das nicht sich mit auf für ist eine auch werden aus haben dass sie nach wird bei einer noch wie über einen so zum war hat nur oder aber vor zur bis mehr durch man sein wurde wenn können schon wir ihre seine zwei jahr gegen vom".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout y aller voir bien où sans tu ou leur homme si deux moi vouloir".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split(),
}


def rows_of(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(8, 60))).capitalize() + ".", lang, "s", 0.5))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, score double"


def test_held_out_accuracy(spark):
    rows = rows_of(600)
    rows += [(1000, None, "en", None, None), (1001, "", "en", None, None), (1002, "12 .. 34", "fr", None, None), (1003, rows[0][1], None, None, None), (None, rows[1][1], rows[1][2], None, None), (1004, "the people " * 60_000, "en", None, None)]
    got = hierarchical_language_id(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    told = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert [told[i].lang_pred for i in (1000, 1001, 1002, 1004)] == ["und", "und", "und", "en"]
    assert told[1003].lang_pred == told[0].lang_pred and told[None].lang_pred == told[1].lang_pred
    out = [(told[i].lang_pred, lang) for i, _, lang, *_ in rows[:600] if told[i].held_out]
    assert len(out) > 100 and sum(a == b for a, b in out) / len(out) > 0.97


def test_held_out_labels_play_no_part(spark):
    rows = rows_of(200)
    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    other = [(r[0], r[1], "xx" if h else r[2], "other", 9.0) for r, h in zip(rows, held, strict=True)]
    one, two = (sorted(map(tuple, hierarchical_language_id(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, other))
    assert one == two


def test_few_or_no_languages(spark):
    docs = spark.createDataFrame([(1, "hello there", None, None, None)], SCHEMA)
    assert [tuple(r) for r in identify(docs, fit(docs)).collect()] == [(1, "und", 0.0)]
    one = spark.createDataFrame([(1, "hello there", "zz", None, None)], SCHEMA)
    assert [tuple(r) for r in identify(docs, fit(one)).collect()] == [(1, "zz", 1.0)]
    assert hierarchical_language_id(docs.limit(0)).collect() == []


def test_texts_stay_where_nothing_can_be_learned(spark):
    texts = [(1, "hello there"), (2, None), (3, "12 !?"), (4, "漢字"), (5, ""), (None, "of no id")]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1][:2]
    for rows in ([(*r, None, "s", 0.5) for r in texts], [(*r, "und", "s", 0.5) for r in texts], [(i, f"hello {i}", "en", "s", 0.5) for i in held]):
        docs = spark.createDataFrame(rows, SCHEMA)
        left = drop_undetermined(docs)
        assert left.columns == docs.columns
        assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.text is not None and any(c.isalpha() for c in r.text))


def test_copies_take_no_places_of_the_sample(spark, monkeypatch):
    import plumbline.llm.language_id as L

    fitted = []
    whole = L._machine
    monkeypatch.setattr(L, "_machine", lambda a, b, rows, *rest: fitted.append(len({(at.tobytes(), x.tobytes()) for at, x in rows})) or whole(a, b, rows, *rest))
    texts = [f"text {i} of many words" for i in range(100)]
    drawn = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "pmod(xxhash64(text), 1000003) as draw").orderBy("draw").collect()
    german = [(10_000 + i, f"texte {i} mit worten", "de", "s", 0.5) for i in range(100)]
    for hot in (drawn[0].text, drawn[-1].text):  # copies that come first, or that not one of comes in
        rows = [(i, t, "en", "s", 0.5) for i, t in enumerate(texts + [hot] * 3000)] + german
        fit(spark.createDataFrame(rows, SCHEMA).repartition(3), sample_texts=40)
    assert fitted == [80, 80]


def test_the_stage_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "ein Wort", "de", 1), (2, "12 34", None, 2), (3, None, "de", 3)], "`d.id` long, `te``xt` string, `la.ng` string, `odd ``one``` int")
    kept = drop_undetermined(docs, "d.id", "te`xt", "la.ng")
    assert [tuple(r) for r in kept.collect()] == [(1, "ein Wort", "de", 1)] and kept.columns == docs.columns
