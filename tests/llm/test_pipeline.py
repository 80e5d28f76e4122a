"""The pipeline's stages, each on its own input, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pixelweave.llm import mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        out.append((name, docs.collect(), rows))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def words5(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_keep_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "near duplicates", "decontamination", "source mixing", "token ids"]
    for _, before, after in stages[:-1]:
        assert after and list(after[0].asDict()) == list(before[0].asDict())


def test_quality_stage(spark, stages):
    _, before, after = stages[0]
    kept = {x["doc_id"] for x in after}
    for x in before:
        n, _, _, _, repeated = quality.base_features(x["text"])
        if n < 20 or 100 * repeated > 30 * n:
            assert x["doc_id"] not in kept
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert kept == {i for i, k in verdict.items() if k}


def test_near_duplicate_stage(stages):
    """A near duplicate is a pair of five-word Jaccard similarity 0.8 or more, over words between white space."""
    _, before, after = stages[1]

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(x["doc_id"], shingles(x["text"])) for x in before]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, p) in enumerate(sets):
        for j, q in sets[:k]:
            if len(p & q) >= 0.8 * len(p | q):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert sorted(x["doc_id"] for x in after) == sorted({find(i) for i, _ in sets})


def test_decontamination_stage(spark, stages):
    _, before, after = stages[2]
    items = [words5(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [x["doc_id"] for x in before if not any(s and len(s & words5(x["text"])) >= 0.8 * len(s) for s in items)]
    assert sorted(x["doc_id"] for x in after) == sorted(clean)


def test_mixing_stage(spark, stages):
    _, before, after = stages[3]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert Counter(x["doc_id"] for x in after) == Counter({i: n for i, n in copies.items() if n})


def test_token_stage_and_run(spark, stages):
    from tokenizers import Tokenizer

    from pixelweave.llm import token_store

    whole = Tokenizer.from_file(token_store.default_tokenizer())
    _, before, after = stages[4]
    text = {x["doc_id"]: x["text"] for x in before}
    start = 0
    for x in sorted(after, key=lambda r: (r["doc_id"], r["start"])):
        ids = [*whole.encode(text[x["doc_id"]], add_special_tokens=False).ids, 2]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += x["n_tokens"]
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, after))
