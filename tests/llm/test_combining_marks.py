"""Capitals that combining marks compose with."""

import zlib

import numpy as np

from pixelweave.llm import token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)


def test_combining_marks_after_capitals(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_store.default_tokenizer())
    texts = ["J̌", "H̱ W̊ T̈ Y̊", "J̌an ǰan JAN jan", "xH̱x XH̱X ̱H ̀A", "plain Words BEFORE J̌ and after", "Á Ḅ̇ Ế"]
    got = {x["doc_id"]: (x["n_tokens"], x["ids_crc32"]) for x in token_store.store_and_verify(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = [*whole.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (len(want), zlib.crc32(np.array(want, "<u4").tobytes())), t
    assert token_store.encoder_for(token_store.default_tokenizer()).by_word
