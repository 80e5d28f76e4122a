"""SimHash, line dedup, decontamination and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from pixelweave.llm import decontaminate, graph, line_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    out = [(0, base), (1, base), (2, base.upper()), (3, base + " tail"), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "one two"), (9, prose(2, 4000)), (10, prose(2, 4000) + " x"), (3, base + " tail"), (None, prose(3, 50)), (None, base)]
    words = base.split()
    for k in range(40):
        changed = list(words)
        changed[k * 3 % 120] = f"new{k}"
        out.append((100 + k, " ".join(changed)))
    return out


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], SCHEMA)


def brute_print(text, k=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {g: min((x for x in m if x is not None), default=None) for g, m in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(spark, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in simhash.near_duplicates(as_docs(spark, rows)).collect())
    prints = [brute_print(t) for _, t in rows]
    want = sorted((i is None, i or 0, f"{p:016x}", -1 if c is None else c) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints)))
    assert got == want


@pytest.mark.parametrize("heavy,block", [(1, 3), (4, 7), (10_000, 10)])
def test_links_keep_every_component_whatever_is_heavy(spark, heavy, block):
    r = random.Random(5)
    centers = [r.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in centers for _ in range(40)} | {r.getrandbits(64) for _ in range(200)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, heavy, block)
    roots = {x["node"]: x["root"] for x in graph.connected_components(edges).collect()}
    want = brute_components(prints, prints)
    groups = {}
    for p, s, w in zip(prints, signed, want):
        groups.setdefault(w, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_threshold_plan_keeps_the_pigeonhole_sum(spark):
    nodes = spark.createDataFrame([(random.Random(i).getrandbits(63),) for i in range(500)], "fp long")
    parts = simhash.plan_partitions(nodes, 4)
    seen = 0
    for mask, flips in parts:
        mask &= (1 << 64) - 1
        assert seen & mask == 0 and flips and 0 in flips
        seen |= mask
    cost, chosen = simhash.allocate([np.array([1.0, 5, 9]), np.array([2.0, 3, 9]), np.array([1.0, 8, 9])], 1)
    assert sum(chosen) == 1 and cost == 1 + 3 + 1


def test_one_document_of_each_group_stays(spark, rows):
    kept = sorted(r["doc_id"] for r in simhash.one_per_group(as_docs(spark, rows)).collect() if r["doc_id"] is not None)
    prints = [brute_print(t) for _, t in rows]
    want = sorted({c for c in brute_components([i for i, _ in rows], prints) if c is not None})
    assert kept == want


def test_empty_tables(spark):
    none = as_docs(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_per_group(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(none, items).count() == 0
    one = as_docs(spark, [(1, prose(1, 30))])
    assert decontaminate.contaminated(one, items).count() == 0
    assert decontaminate.without_leaks(one, items).count() == 1


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50))


def brute_lines(rows, window=3):
    first = {}
    order = sorted(((i is not None, i or 0), k) for k, (i, _) in enumerate(rows))
    places = []
    for key, k in order:
        lines = (rows[k][1] or "").split("\n")
        for at in range(len(lines) - window + 1):
            w = "\n".join(lines[at : at + window])
            if re.search(r"[^\x20\x09-\x0D]", w):
                places.append((k, key, at, w))
                first[w] = min(first.get(w, (key, at)), (key, at))
    gone = {}
    for k, key, at, w in places:
        if (key, at) > first[w]:
            gone.setdefault(k, set()).update(range(at, at + window))
    return [(i, t if k not in gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k]), len(gone.get(k, ()))) for k, (i, t) in enumerate(rows)]


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(3)
    lines = [f"line {k}" for k in range(12)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 30)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (103, "a\nb\nc"), (104, "a\nb\nc\nd"), (None, "a\nb\nc"), (105, "\n\n\n\n"), (106, "\n\n\n\n"), (104, "a\nb\nc\nd"), (107, "x\nx\nx\nx\nx")]
    docs = as_docs(spark, rows).withColumnRenamed("n_chars", "n_lines")
    got = sorted(((x["doc_id"], x["text"], x["n_removed"]) for x in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)


def brute_containment(docs, items, k=5, threshold=0.8):
    def shingles(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = set()
    for i, t in docs:
        held = shingles(t)
        for j, u in items:
            want = shingles(u)
            if want and len(want & held) / len(want) >= threshold:
                out.add((i, j, round(len(want & held) / len(want), 9)))
    return out


def test_decontamination_matches_brute_force(spark):
    items = [(k, prose(1000 + k, 4 + k)) for k in range(60)] + [(900, None), (901, ""), (902, "too few words here")]
    docs, r = [], random.Random(8)
    for k in range(80):
        filler, words = prose(k, r.choice([0, 3, 50, 400, 3000])).split(), items[r.randrange(60)][1].split()
        if k % 4 == 1:
            words[r.randrange(len(words))] = "changed"
        if k % 4 == 2:
            words = words[: len(words) * 9 // 10]
        at = r.randrange(len(filler) + 1)
        docs.append((k, " ".join(filler[:at] + [w.upper() if k % 3 else w + "," for w in words] + filler[at:])))
    docs += [(500, None), (501, ""), (3, docs[3][1]), (None, items[30][1])]
    got = {(x["doc_id"], x["item_id"], round(x["containment"], 9)) for x in decontaminate.contaminated(as_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_containment(docs, items)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40
    kept = decontaminate.without_leaks(as_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    bad = {i for i, _, _ in got}
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_registered_decontamination_against_brute_force(spark):
    import pyarrow.parquet as pq

    from pixelweave.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = [(x["doc_id"], x["text"]) for x in pq.read_table(f"{d}/documents.parquet").to_pylist()]
    items = [(x["item_id"], x["text"]) for x in pq.read_table(f"{d}/benchmark.parquet").to_pylist()]
    got = {(x["doc_id"], x["item_id"], round(x["containment"], 9)) for x in QUERIES["op8_decontamination"](spark, d).collect()}
    assert got == brute_containment(docs, items)
