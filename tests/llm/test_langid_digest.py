"""Languages and centroid digests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import digest
from tidewright.llm.langid import LangParams, detect, evidence, label_cases, label_language, sample, train

LANGS = [("de", "German"), ("en", "English"), ("es", "Spanish"), ("ja", "Japanese")]
TEXT = {
    "en": ["the price table has many rows and columns", "before plotting we have to sort the sample by date", "most of the time is spent on the residual plot", "we load the training set first and compare it with the other one"],
    "de": ["die Preistabelle hat viele Zeilen und Spalten", "vor dem Zeichnen müssen wir die Stichprobe nach Datum sortieren", "die meiste Zeit geht für das Residuendiagramm drauf", "wir laden zuerst die Trainingsmenge und vergleichen sie dann"],
    "es": ["la tabla de precios tiene muchas filas y columnas", "antes de dibujar hay que ordenar la muestra por fecha", "la mayor parte del tiempo se va en el gráfico", "primero cargamos el conjunto de entrenamiento y luego lo comparamos"],
    "ja": ["価格表には多くの行と列があります。", "描画の前に標本を日付順に並べる必要があります。", "時間の大半は残差図に費やされます。", "まず訓練データを読み込み、比較します。"],
}
SCHEMA = "doc_id bigint, text string, lang string, cells array<struct<cell_no:int,cell_type:string,exec_count:int,start_pos:int,body_chars:int>>"


def document(i, label, cells):
    text, out = "", []
    for k, (kind, body) in enumerate(cells):
        text += "## "
        out.append((k, kind, None, len(text), len(body)))
        text += body + "\n"
    return (i, text, label, out)


def corpus():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        lang = list(TEXT)[i % 4]
        body = [". ".join(rng.choice(TEXT[lang], 3)) for _ in range(3)]
        rows.append(document(i, lang if i % 12 else list(TEXT)[(i + 1) % 4], [("text", b) for b in body] + [("code", TEXT["en"][0])]))
    return rows


def test_labels(spark):
    labels = ["en", "EN", " eng ", "English", "en-US", "en_GB", "en (US)", "ger", "deu", "de-AT", "Spanish", "jpn", "ja-JP", "und", "unknown", "", " ", None, "fr", "english language", "enx"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(label_language(F.col("l"), LANGS)).collect()]
    assert got == ["en"] * 7 + ["de"] * 3 + ["es", "ja", "ja"] + [None] * 6 + ["en", None]


def test_evidence():
    assert evidence("See `code x` and [name](https://a.b/c) “ein Zitat” 12 $x^2$ <b>bold</b>") == ["see", "and", "name", "bold"]
    assert evidence("“ein Zitat”") == ["ein", "zitat"] and evidence("") == [] and evidence("``` 1 2```") == []
    assert evidence("fÃ¼r StraÃ\x9fe") == ["für", "straße"]


def test_detect(spark):
    rows = corpus()
    rows += [
        document(1000, "en", [("text", TEXT["en"][0] + TEXT["en"][1]), ("text", TEXT["de"][0])]), document(1001, None, [("text", TEXT["es"][0])]), document(1002, "en", [("code", TEXT["en"][0])]),
        document(1003, "de", [("text", ""), ("text", "123 `x`"), ("text", TEXT["de"][1])]), (1004, None, "en", []), (1005, "", "en", None), (1006, "short", "en", [(0, "text", None, 2, 999), (1, "text", None, None, None), None]),
        document(1007, "ja", [("text", TEXT["ja"][0] * 3000)]), document(1008, "es", [("text", TEXT["es"][1].upper())]), document(1009, "de", [("text", "mussen wir die Stichprobe sortieren")]), document(1009, "de", [("text", "mussen wir die Stichprobe sortieren")]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"label": F.lit("clash"), "main": F.lit(1), "_label": F.lit(2), "confidence": F.lit(3)})
    out = detect(df, LANGS)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 240 + 8
    assert all(got[i].main == list(TEXT)[i % 4] for i in range(240))
    assert [c.lang for c in got[1000].cells] == ["en", "de"] and [c.lang for c in got[1003].cells] == ["de"] * 3
    assert 1002 not in got and 1004 not in got and 1005 not in got and len(got[1006].cells) == 2
    assert got[1007].main == "ja" and got[1008].main == "es" and got[1009].main == "de"
    assert all(0 < c.confidence <= 1 for r in got.values() for c in r.cells)
    cases = {(r.doc_id, r.cell_no, r.lang) for r in label_cases(out).collect()}
    wrong = {(i, -1, list(TEXT)[i % 4]) for i in range(0, 240, 12)}
    assert {c for c in cases if c[0] != 1006} == wrong | {(1000, 1, "de"), (1001, -1, "es")}


def test_held_out_accuracy():
    rng = np.random.default_rng(4)
    code = [c for c, _ in LANGS]
    make = lambda k, n: [(code.index(lang), evidence(". ".join(rng.choice(TEXT[lang], k)))) for lang in TEXT for _ in range(n)]
    who = train(make(3, 40), code, LangParams())
    test = make(1, 50)
    total, size = who.scorer.cells([w for _, w in test])
    assert np.mean(total.argmax(axis=1) == [x for x, _ in test]) > 0.98
    p = who.posterior(total, size)
    assert np.allclose(p.sum(axis=1), 1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([document(1, None, [("text", "hello")])], SCHEMA)
    assert detect(df, LANGS).count() == 1
    assert detect(df.limit(0), LANGS).count() == 0


FINNISH = "tämä taulukko sisältää paljon rivejä ja sarakkeita, jotka täytyy järjestää ennen kuin kuvaaja voidaan piirtää näytteestä"


def test_other_languages_are_rejected_whatever_the_label(spark):
    labels = ["en", "de", "es", "ja", None, "fi"]
    rows = corpus() + [document(2000 + i, label, [("text", FINNISH)]) for i, label in enumerate(labels)] + [document(2100 + i, label, [("text", "123"), ("text", "")]) for i, label in enumerate(labels)]
    rows += [document(2200, "de", [("text", FINNISH), ("text", TEXT["en"][0] + " " + TEXT["en"][1])])]
    who = train(sample(spark.createDataFrame(corpus(), SCHEMA), LANGS, LangParams()), [c for c, _ in LANGS])
    out = detect(spark.createDataFrame(rows, SCHEMA), LANGS, who=who)
    got = {r.doc_id: r for r in out.collect()}
    for i in range(len(labels)):
        assert got[2000 + i].main is None and [(c.lang, c.reason) for c in got[2000 + i].cells] == [(None, "unlike")]
        assert got[2100 + i].main is None and {c.reason for c in got[2100 + i].cells} == {"no evidence"}
    assert got[2200].main == "en" and [c.lang for c in got[2200].cells] == [None, "en"]
    assert {(r.doc_id, r.cell_no, r.lang) for r in label_cases(out).filter("doc_id >= 2000").collect()} == {(2200, -1, "en")}


def test_the_label_takes_no_part_in_the_language(spark):
    found = []
    for shift in range(3):
        rows = corpus() + [document(3000 + i, list(TEXT)[(i + shift) % 4], [("text", w)]) for i, w in enumerate(["plot", "tabla", "Total", "die", "la", "sort", "data", "Preis"])]
        df = spark.createDataFrame(rows, SCHEMA)
        who = train([(list(c for c, _ in LANGS).index(lang), evidence(". ".join(TEXT[lang][:k]))) for lang in TEXT for k in (1, 2, 3, 4) for _ in range(5)], [c for c, _ in LANGS])
        found.append({r.doc_id: (r.main, r.confidence, [tuple(c) for c in r.cells]) for r in detect(df, LANGS, who=who).filter("doc_id >= 3000").collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 8


def test_whole_documents_and_long_cells_count():
    code = [c for c, _ in LANGS]
    # the words that tell the language come after many characters
    cells = [(code.index(lang), evidence("123 " * 3000 + TEXT[lang][i])) for lang in TEXT for i in range(4) for _ in range(8)]
    who = train(cells, code)
    total, size = who.scorer.cells([evidence(" ".join(TEXT["de"])), evidence(" ".join(TEXT["de"] * 50))])
    p = who.posterior(total, size)
    assert p.argmax(axis=1).tolist() == [code.index("de")] * 2 and p[1].max() >= p[0].max() > 0.9


# ---- digests


def rows(spark):
    rng = np.random.default_rng(2)
    data = [("a", i % 5, float(v)) for i, v in enumerate(rng.lognormal(0, 1, 30_000))] + [(None, 1, float(v)) for v in np.round(rng.normal(size=2000), 1)] + [("c", 1, 7.0)] * 500 + [("d", 2, 1.5)]
    data += [("a", 1, None), ("a", 1, float("nan")), ("a", 2, float("inf")), ("e", 1, None)]
    return spark.createDataFrame(data, "g string, l int, v double").withColumns({"means": F.lit("clash"), "w": F.lit(1)}).repartition(7)


PROBS = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def test_digest_ranks_are_certified(spark):
    df = rows(spark)
    per_load = digest.digests(df, ["g", "l"], "v")
    whole = digest.merge(per_load, ["g"])
    out = digest.certify(df, ["g"], "v", digest.percentiles(whole, ["g"], PROBS), PROBS).collect()
    assert {(r.g, r.n) for r in out} == {("a", 30_000), (None, 2000), ("c", 500), ("d", 1)} and len(out) == 4 * len(PROBS)
    assert all(r.rank_error * r.n <= max(digest.RANK_BOUND * r.n, 1) for r in out)
    values = np.array([r.v for r in df.filter("g = 'a' and v is not null and not isnan(v) and v < 1e300").collect()])
    for r in out:
        if r.g == "a":
            assert r.below == (values < r.estimate).sum() and r.upto == (values <= r.estimate).sum()
        if r.g == "c":
            assert r.estimate == 7.0
    assert all(len(r.means) <= digest.DELTA / 2 + 3 and sum(r.weights) == r.n for r in whole.collect())


def test_digests_combine_in_any_order():
    rng = np.random.default_rng(3)
    parts = [rng.normal(i, 1, 3000) for i in range(6)]
    small = [digest.cluster(p, np.ones(len(p))) for p in parts]
    x = np.concatenate(parts)
    for order in ([0, 1, 2, 3, 4, 5], [5, 3, 1, 0, 2, 4]):
        m, w = digest.cluster(np.concatenate([small[i][0] for i in order]), np.concatenate([small[i][1] for i in order]))
        for q in (0.01, 0.25, 0.5, 0.9, 0.99):
            est = digest.quantile(m, w, x.min(), x.max(), q)
            assert abs((x < est).mean() - q) < 0.003
    with pytest.raises(IndexError):
        digest.cluster(np.zeros(0), np.zeros(0))


def test_empty_digests(spark):
    df = rows(spark)
    assert digest.digests(df.limit(0), ["g"], "v").count() == 0
    assert digest.digests(df.filter("g = 'e'"), ["g"], "v").count() == 0


def test_groups_over_the_bound_are_summarised_again(spark, monkeypatch):
    df = rows(spark)
    coarse = digest.merge(digest.digests(df, ["g"], "v", 6), ["g"], 6)
    first = {(r.g, r.p): r for r in digest.certify(df, ["g"], "v", digest.percentiles(coarse, ["g"], PROBS), PROBS).collect()}
    assert any(r.rank_error * r.n > max(digest.RANK_BOUND * r.n, 1) for r in first.values())
    out = {(r.g, r.p): r for r in digest.certified(df, ["g"], "v", coarse, PROBS).collect()}
    assert out.keys() == first.keys() and all(r.rank_error * r.n <= max(digest.RANK_BOUND * r.n, 1) for r in out.values())
    assert digest.certified(df.limit(0), ["g"], "v", coarse.limit(0), PROBS).count() == 0
