"""Source divergence and importance resampling against brute force, with nulls, repeats, hot terms and several shards."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow.parquet as pq
import pytest

from pixelweave.llm import divergence, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def lower_az(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- divergence ---


def brute_audit(rows, least, top):
    docs, groups, counts = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower_az(text))
        counts[group].update(terms)
        docs[group[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        count = {s: {t: counts[lang, s][t] for t in kept} for s in own}
        count[None] = {t: sum(count[s][t] for s in own) for t in kept}
        p = {s: {t: 1 + math.floor(Fraction(10**9 * (c[t] + 5), sum(c.values()) + 5 * len(kept))) for t in kept} for s, c in count.items()}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked if part == "pair" else ranked[:top])]
    return sorted(out)


def audit_rows(seed=1, n=240):
    r = random.Random(seed)
    words = ["the", "The", "Straße", "été", "k9mer", "x-ray", "中文", "\U0001f600", "Kelvin", *[f"w{chr(97 + k)}" for k in range(26)]]
    rows = []
    for k in range(n):
        text = " ".join(r.choice(words[: r.randrange(3, len(words))]) for _ in range(r.randrange(1, 30)))
        rows.append((k, r.choice([text, text, text, None, "", "12 34"]), r.choice(["en", "en", "de", None, ""]), r.choice(["a", "b", "c", None, "é"])))
    return [*rows, *rows[:20], (None, "the end", "xx", "alone"), (1, "the the", "yy", "p"), (1, None, "yy", "q")]


@pytest.mark.parametrize("small", [False, True])
def test_audit_matches_brute_force(spark, monkeypatch, small):
    rows = audit_rows()
    if small:  # many sorts in a task, many shards and blocks
        monkeypatch.setattr(divergence, "SORTED", 50)
        monkeypatch.setattr(divergence, "SHARD", 7)
        monkeypatch.setattr(divergence, "BLOCK", 2)
    for parts in (1, 5):
        got = [tuple(r) for r in divergence.audit(frame(spark, rows).repartition(parts), least_docs=9, top=4).collect()]
        assert sorted(got) == brute_audit(rows, 9, 4)


def test_audit_of_nothing_and_without_kept_terms(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, "c", "de", "y")]
    got = [tuple(r) for r in divergence.audit(frame(spark, rows)).collect()]
    assert sorted(got) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_audit_with_other_columns_and_a_long_text(spark):
    rows = [(k, "common " * (60_000 if k == 3 else 1) + "own" * (k % 2), "en", "ab"[k % 2]) for k in range(40)]
    docs = frame(spark, rows)
    for c in ("term", "document", "df", "n", "shard", "block", "mine"):
        docs = docs.withColumn(c, docs["n_chars"])
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == brute_audit(rows, 30, 50)


def test_share_is_exact():
    import numpy as np

    r = random.Random(3)
    for _ in range(2000):
        b = r.randrange(1, 9 * 10**15)
        a = r.randrange(0, b + 1)
        assert int(divergence.share(np.array([a]), np.array([b]))[0]) == 1 + 10**9 * a // b


def test_runs_that_span_batches_are_one(spark):
    rows = [("en", "t", s, d, 1, 2) for s in "ab" for d in range(50)] + [("en", "u", "a", 1, 30, 30)]
    runs = spark.createDataFrame(rows, divergence.RUNS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r["term"]: (r["n"], r["sources"], r["counts"]) for r in divergence.merged_runs(runs, 30).collect()}
    assert got == {"t": (200, ["a", "b"], [100, 100]), "u": (30, ["a"], [30])}


# --- resampling ---


def brute_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))], len(w)


def brute_resample(rows, target, buckets=10_000):
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    docs = [(i, *brute_features(t)) for i, t, _, _ in rows]
    s = Counter(crc(g) for _, found, _ in docs for g in found)
    t = Counter(crc(g) for text in target for g in brute_features(text)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, found, n in docs:
        weight = sum(gain[crc(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[: 25 * len(able) // 100]):
        x[4] = k + 1
    return sorted(map(str, (x[:5] for x in out)))


def sampled(docs, target, **how):
    return sorted(str(list(r)) for r in resampling.resample(docs, target, **how).collect())


def resample_rows(n=150):
    r = random.Random(2)
    words = ["the", "The", "straße", "ÉTÉ", "k9", "中文", "\U0001f600", "Kelvin", *[f"w{k}" for k in range(60)]]
    rows = [(k, r.choice(["-", " ", ". "]).join(r.choice(words) for _ in range(r.randrange(0, 60))), "en", "s") for k in range(n)]
    return [*rows, (None, "the word " * 15, None, None), (3, None, None, None), (4, "", None, None), (5, rows[5][1], "en", "s"), (5, rows[5][1], "en", "s")]


def test_resampling_matches_brute_force(spark, monkeypatch):
    rows, target = resample_rows(), ["the straße w1 w2", None, "", "w1 w2 w3 W1 w2"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    want = brute_resample(rows, target)
    for parts in (1, 6):
        assert sampled(frame(spark, rows).repartition(parts), items) == want
    monkeypatch.setattr(resampling, "SLICE", 5)
    monkeypatch.setattr(resampling, "BLOCK_FEATURES", 100)
    monkeypatch.setattr(resampling, "CACHE", 10)
    assert sampled(frame(spark, rows), items) == want
    assert sampled(frame(spark, rows), items, buckets=100_000) == brute_resample(rows, target, 100_000)


def test_resampling_edges(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(frame(spark, []), items).count() == 0
    rows = [(k, "one two three " * (7 + 4000 * (k == 2)), "en", "s") for k in range(9)]
    docs = frame(spark, rows)
    for c in ("id", "ids", "score", "rank", "weight", "place", "range_no"):
        docs = docs.withColumn(c, docs["n_chars"])
    assert sampled(docs, items) == brute_resample(rows, [])


def test_csr_blocks_hold_the_matrix(spark):
    rows = resample_rows(40)
    seen = []
    for b in resampling.csr_blocks(frame(spark, rows).coalesce(1)).toArrow().to_batches():
        for ids, (columns, counts, ends) in zip(b.column("ids").to_pylist(), resampling.entries(b, 10_000)):
            for k, (i, end) in enumerate(zip(ids, ends.tolist())):
                begin = int(ends[k - 1]) if k else 0
                seen.append((i, sorted(zip(columns[begin:end].tolist(), counts[begin:end].tolist()))))
    want = [(i, sorted(Counter(zlib.crc32(g.encode()) % 10_000 for g in brute_features(t)[0]).items())) for i, t, _, _ in rows]
    assert sorted(seen, key=str) == sorted(want, key=str)


def test_a_task_holds_little_of_the_matrix_at_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(resampling, "discard", lambda *t: tables.extend(t))
    docs = spark.range(0, 800, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 3000), k -> hex(pmod(xxhash64(id, k), 1000000))), ' ') AS text")
    assert resampling.resample(docs, docs.limit(1)).count() == 800
    files = [pq.ParquetFile(f).metadata for f in glob.glob(tables[0].written_to.removeprefix("file://") + "/*.parquet")]
    sizes = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert sum(sizes) > 16 << 20 and max(sizes) < 10 << 20
