"""Best-fit packing by islands: the tokenizer's ids, whole coverage, tight sequences, the genetic operators."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pixelweave.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "another text with that id"), (None, "no id  here\n\n x"), (4, "word " * 1023), (5, "word " * 1024), (6, "x y\t\n z" * 3000), (7, "<|endoftext|> it's")]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.default_tokenizer())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def ids_of(whole, text):
    return [*whole.encode(text or "", add_special_tokens=False).ids, 2]


def check_pieces(whole, texts, rows, space=1024):
    """Every id of every document is in one piece, sequences are gapless and within their space."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in of_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= space
    want = []
    for i, text in texts:
        ids = ids_of(whole, text)
        first = (len(ids) - 1) % space + 1
        bounds = [0, *range(first, len(ids) + 1, space)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return len(of_sequence)


def test_chunks_have_the_tokenizers_ids(whole, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    encoder, r = packing.ChunkEncoder(packing.default_tokenizer()), random.Random(5)
    letters = "abcXYZ 019  \t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u180e\u2003\u2028\u202f\u200b\u3000\ufeff'''sdtmlrev.,!-_éßñøŠ中文字كتاب\U0001f600\u0301\u0130\u017f\u212a"
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(120)))
        assert encoder.ids(text).tolist() == ids_of(whole, text)[:-1], ascii(text)
    for _ in range(2000):
        text = "".join(chr(c) for c in (r.choice((r.randrange(0x20, 0x250), r.randrange(0x20, 0xD800), r.randrange(0x10000, 0x1F9FF), 32, 32, 10)) for _ in range(30)))
        assert encoder.ids(text).tolist() == ids_of(whole, text)[:-1], ascii(text)


def test_pieces_of_the_table(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    texts = [(x["doc_id"], x["text"]) for x in docs.collect()]
    used = check_pieces(whole, texts, rows)
    assert used <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_edges(spark, whole):
    check_pieces(whole, EDGES, packing.pack(frame(spark, EDGES)).collect())
    assert packing.pack(frame(spark, [])).count() == 0
    docs = frame(spark, EDGES[:4])
    for c in ("id", "key", "piece", "cell", "bin", "length", "sequence_id"):
        docs = docs.withColumn(c, docs["n_chars"])
    assert packing.pack(docs).count() == 4
    rows = packing.pack(frame(spark, EDGES), space=7).collect()
    check_pieces(whole, EDGES, rows, 7)


def test_sequences_hold_the_ids(spark, whole):
    rows = [(k, f"text number {k} " * (k % 40)) for k in range(60)]
    packed = packing.pack(frame(spark, rows), space=128, with_ids=True)
    packed.persist()
    got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    text = dict(rows)
    for r in packed.collect():
        ids = got[r["sequence_id"]]
        assert len(ids) <= 128 and ids[r["offset"] : r["offset"] + r["length"]] == ids_of(whole, text[r["doc_id"]])[r["start"] : r["start"] + r["length"]]


def lengths_of(seed, n=700, space=1000):
    r = np.random.default_rng(seed)
    return r.integers(space // 5, space // 2 + 50, n).astype(np.int64)


def test_best_fit_takes_the_fullest_bin_with_room():
    lengths, fills = np.array([30, 50, 20]), [60, 55, 10]
    of = np.zeros(3, np.int32)
    packing.best_fit(of, lengths, np.arange(3), fills, 100)
    assert of.tolist() == [0, 2, 2] and fills == [90, 55, 80]


def test_crossover_keeps_every_piece_and_whole_bins():
    rng = np.random.default_rng(1)
    lengths = lengths_of(2)
    one, other = (packing.packed(lengths, rng.permutation(len(lengths)), 1000) for _ in range(2))
    theirs = {frozenset(np.flatnonzero(other == b).tolist()) for b in range(other.max() + 1)}
    for _ in range(20):
        child = packing.crossover(one, other, lengths, 1000, rng)
        fills = packing.filled(child, lengths)
        assert len(child) == len(lengths) and fills.max() <= 1000 and fills.min() > 0
        own = {frozenset(np.flatnonzero(child == b).tolist()) for b in range(child.max() + 1)}
        assert own & theirs


def test_evolution_never_loses_and_beats_best_fit_on_hard_lengths():
    gained = 0
    for seed in range(3):
        rng, lengths = np.random.default_rng(seed), lengths_of(seed)
        members = packing.founders(lengths, None, 1000, 6, rng)
        before = max(packing.fitness(m, lengths, 1000) for m in members)
        best = packing.evolve(lengths, members, 1000, 60, rng)[0]
        assert packing.fitness(best, lengths, 1000) >= before
        gained += packing.fitness(best, lengths, 1000) > before
    assert gained == 3


def test_many_cells_stay_near_the_bound(spark):
    n = 12_000
    r = np.random.default_rng(9)
    lengths = r.integers(1, 700, n).tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    for cell in (500, 5000):
        rows = packing.layout(pieces, cell=cell).collect()
        assert sorted(x["key"] for x in rows) == list(range(n))
        held = defaultdict(int)
        for x in rows:
            held[x["sequence_id"]] += lengths[x["key"]]
        assert max(held.values()) <= 1024 and len(held) <= 1.002 * sum(lengths) / 1024
