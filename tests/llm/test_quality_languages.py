"""Languages whose texts teach the perplexity model nothing."""

import random

from pixelweave.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)


def test_a_language_of_symbol_rich_texts_is_not_rejected_whole(spark):
    r = random.Random(2)
    prose = lambda: " ".join(r.choice("the cat sat on a mat while it was raining over many green hills today".split()) + r.choice("abcdefg") for _ in range(80))
    code = lambda: " ".join(f"x{r.randrange(99)} = y{r.randrange(99)} & z | {r.randrange(99)}% <b> #{r.randrange(99)}" for _ in range(20))
    rows = [(i, prose(), "en") for i in range(30)] + [(100 + i, code(), "code") for i in range(10)]
    got = {x["doc_id"]: x["kept"] for x in quality.judge(frame(spark, rows)).collect()}
    assert all(got[i] for i in range(30)) and all(got[100 + i] for i in range(10))
