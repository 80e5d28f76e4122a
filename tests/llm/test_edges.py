"""Clashing names, shared ids, many languages, letters beyond the basic plane, very long texts and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import decontaminate, language_id, license_scan, line_dedup, mixing, near_copies, quality, secret_scan, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "mark", "of", "of_mark", "row", "fp", "node", "group", "starts", "n", "key", "size", "copies", "copy", "kept", "band", "words", "_of", "_mark", "_text", "_alone", "n_words", "base_failed"]


def frame(spark, rows):
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in full], SCHEMA)


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice("alpha bravo charlie delta echo foxtrot golf hotel india".split()) + "abcdefgh"[r.randrange(8)] for _ in range(n))


STAGES = {
    "quality": lambda d, b: quality.keep_good(d),
    "simhash": lambda d, b: simhash.one_per_group(d),
    "near": lambda d, b: near_copies.one_per_group(d),
    "leaks": lambda d, b: decontaminate.without_leaks(d, b),
    "mixed": lambda d, b: mixing.mixed(d),
    "lines": lambda d, b: line_dedup.dedup_lines(d).drop("n_lines", "n_removed"),
}


@pytest.mark.parametrize("name", STAGES)
def test_columns_of_any_name_come_through(spark, name):
    rows = [(k, prose(k) + "\na\nb\nc", "en", "s") for k in range(6)] + [(None, prose(7), None, None), (7, "", "en", "s"), (8, None, "en", "s")]
    docs = frame(spark, rows)
    items = spark.createDataFrame([(1, prose(3, 20))], "item_id long, text string")
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, docs["n_chars"] + k)
    docs = docs.withColumn("a.b", docs["n_chars"]).withColumn("tags", F.create_map(F.lit("k"), F.col("n_chars")))
    out = STAGES[name](docs, items)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(x[c] == k for x in got for k, c in enumerate(CLASHING))
    assert STAGES[name](docs.filter("false"), items).count() == 0


@pytest.mark.parametrize("keep", [simhash.one_per_group, near_copies.one_per_group])
def test_rows_that_share_an_id_are_different_documents(spark, keep):
    rows = [(1, prose(1)), (1, prose(2)), (1, prose(2)), (2, prose(2)), (3, prose(1)), (None, prose(4)), (None, prose(5)), (None, prose(5)), (None, prose(1))]
    want = sorted([(1, prose(1)), (1, prose(2)), (None, prose(4)), (None, prose(5))], key=str)
    for n in (1, 4):
        assert sorted(((x["doc_id"], x["text"]) for x in keep(frame(spark, rows).repartition(n)).collect()), key=str) == want


def test_every_language_and_letter_is_learned(spark):
    r = random.Random(3)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0x3B1, 0x3CA), *range(0x430, 0x450), *range(0x10330, 0x1034A), *range(0x1E922, 0x1E940)]]
    rows = []
    for k in range(250):
        own = r.sample(letters, 7)
        rows += [(1000 * k + j, " ".join("".join(r.choice(own) for _ in range(5)) for _ in range(60)), f"l{k:03}") for j in range(4)]
    rows += [(10**6 + j, "".join(chr(0x10330 + (j + i) % 20) + (" " if i % 6 == 5 else "") for i in range(200)), "got") for j in range(6)] + [(5, "\U0001f600 123", None)]
    got = {x["doc_id"]: x for x in language_id.identify(frame(spark, rows)).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[:1000]]) > 0.95
    assert all(got[10**6 + j]["lang_pred"] == "got" and got[10**6 + j]["score"] > 0.5 for j in range(6)) and got[5]["lang_pred"] == "und"


def test_language_predictions_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()).selectExpr("doc_id key", "text", "lang"))

    rows = docs.collect()
    got = {x["doc_id"]: x for x in language_id.predict(docs, model).collect()}
    seen = np.zeros(language_id.FEATURES)
    training = [x for x in docs.filter(~language_id.held_out()).collect() if x["lang"] is not None]
    for x in training:
        seen[list({int(f) for f in language_id.feature_ids(x["text"])})] += 1
    idf = np.log((len(training) + 1) / (seen + 1)) + 1
    assert np.allclose(idf, model.idf, rtol=1e-5)
    for x in rows:
        weights = {}
        for f in language_id.feature_ids(x["text"]).tolist():
            weights[f] = weights.get(f, 0) + 1
        if not weights:
            assert got[x["doc_id"]]["lang_pred"] == "und" and got[x["doc_id"]]["score"] == 0
            continue
        weights = {f: (1 + np.log(n)) * idf[f] for f, n in weights.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        cosines = [sum(w * float(c[f]) for f, w in weights.items()) / norm for c in model.centers]
        best = max(cosines)
        assert abs(got[x["doc_id"]]["score"] - best) < 1e-4
        assert got[x["doc_id"]]["lang_pred"] in {model.langs[k] for k, c in enumerate(cosines) if c > best - 1e-4}


def test_a_model_in_parts_predicts_as_one(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-x"))).otherwise(F.col("lang")))
    training = docs.selectExpr("doc_id key", "text", "lang")
    whole = language_id.fit_table(training)
    want = {x["doc_id"]: x for x in language_id.predict(docs, whole).collect()}
    monkeypatch.setattr(language_id, "PART", 6)
    parts = language_id.fit_table(training)
    assert parts.parts > 2 and max(r["count"] for r in parts.table.groupBy("part").count().collect()) <= 6
    got = {x["doc_id"]: x for x in language_id.predict(docs, parts).collect()}
    assert all(got[i]["lang_pred"] == x["lang_pred"] and abs(got[i]["score"] - x["score"]) < 1e-6 and got[i]["rejected"] == x["rejected"] for i, x in want.items())
    with pytest.raises(ValueError):
        language_id.fit(training)


def test_empty_tables_and_very_long_texts(spark):
    none = frame(spark, [])
    assert language_id.identify(none).count() == 0
    assert secret_scan.digest(secret_scan.scan(none)).count() == 0
    assert license_scan.digest(license_scan.scan(none)).count() == 0
    long = "\n".join(f"line {k} of words" for k in range(60_000))
    docs = frame(spark, [(1, long, "en", "s"), (2, long, "en", "s"), (3, None, "en", "s")])
    got = {x["doc_id"]: (x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (60_000, 0), 2: (60_000, 60_000), 3: (1, 0)}
    assert {x["doc_id"]: x["size"] for x in mixing.mix(docs).collect()} == {1: 240_000, 2: 240_000, 3: 0}
    items = spark.createDataFrame([(1, "line 59998 of words line 59999 of words")], "item_id long, text string")
    assert {x["doc_id"] for x in decontaminate.without_leaks(docs, items).collect()} == {3}
