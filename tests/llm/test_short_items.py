"""Benchmark items under five words, and in scripts without spaces."""

from pixelweave.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def found(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    items = spark.createDataFrame(items, "item_id long, text string")
    pairs = sorted((x["doc_id"], x["item_id"], x["containment"]) for x in decontaminate.contaminated(docs, items).collect())
    kept = {x["doc_id"] for x in decontaminate.without_leaks(docs, items).collect()}
    assert kept == {x["doc_id"] for x in docs.select("doc_id").collect()} - {i for i, _, _ in pairs}
    return pairs


def test_items_under_five_words(spark):
    items = [(1, "Quagga"), (2, "capital of Ruritania"), (3, "who wrote Zenda novel"), (4, ""), (5, None), (6, "?!")]
    docs = [(1, "a QUAGGA, grazed"), (2, "the capital of Ruritania is far away from here"), (3, "capital of the Ruritania"), (4, "who wrote zenda novel"), (5, "who wrote the zenda novel, and quaggas"), (6, ""), (7, None), (8, "word " * 3000 + "capital of, ruritania!")]
    assert found(spark, docs, items) == [(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0), (8, 2, 1.0)]


def test_scripts_without_spaces(spark):
    items = [(1, "法国的首都是哪里？答案是巴黎。"), (2, "日本で一番高い山は富士山です"), (3, "เมืองหลวงของไทยคือกรุงเทพ"), (4, "什么")]
    docs = [(1, "前言，很长的一段话。法国的首都是哪里？答案是巴黎。后面还有别的内容"), (2, "本文：日本で一番高い山は富士山です。終わり"), (3, "ข้อความเมืองหลวงของไทยคือกรุงเทพครับ"), (4, "首都法国是的哪里答案巴黎是"), (5, "这是什么东西"), (6, "什 么"), (7, "plain “quoted” words’ only – here, and more of them")]
    got = found(spark, docs, items)
    assert [(i, k) for i, k, _ in got] == [(1, 1), (2, 2), (3, 3), (5, 4), (6, 4)]
