"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Every text gets a 64-bit SimHash of its word shingles.
2. Equal fingerprints become one node, so exact copies cost one row.
3. The 64 bits are grouped into partitions, correlated bits together. A
   dynamic programme gives each partition its own threshold ``t_i`` with
   ``sum(t_i) = radius - m + 1``: by the generalised pigeonhole principle two
   fingerprints within ``radius`` differ by at most ``t_i`` bits in some
   partition ``i``. Its costs are candidate counts estimated from the bit
   statistics and the partition populations of all fingerprints.
4. Each node is indexed once per partition, meets the nodes of its own value
   there, and probes the rest of the ball of radius ``t_i`` around it;
   candidates are verified over all 64 bits.
5. Links form components (large-star / small-star).

A partition value that very many nodes share (``heavy``) is not joined row by
row: its nodes are dealt into blocks, each pair of blocks is compared in one
bounded task, and only a spanning forest of the block's links is returned.
So no link between different fingerprints is lost for the components, and the
rows stay linear in a group's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import LOWER_AZ, blank, forget, materialize, rows_kept, small_batches
from pixelweave.llm.graph import component_names, connected_components

BITS = 64
SEED = 42
#: A probe is a shuffled row; a candidate is a comparison inside a join.
PROBE_COST = 4.0


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text as a signed 64-bit integer (bit 63 is the sign)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    array = np.array(hashes, np.uint64)
    for k in range(0, len(array), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(array[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(array), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """``docs`` with the column ``fp`` (signed 64 bits) in place of the text. Null text: 0."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn("fp", hashed(F.col(text))).drop(text)


# --- planning: which bits go together, and how far each partition is probed ---


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, share of ones per bit and the bits' correlation, over all nodes.

    Each task sends back one row of 64 x 65 sums, whatever it has read.
    """

    def sums(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pd.DataFrame({"n": [n], "both": [both.ravel().tolist()]})

    parts = nodes.select("fp").mapInPandas(sums, "n long, both array<long>")
    summed = parts.select("n", F.posexplode("both").alias("k", "c")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()
    if not summed or not summed[0]["n"]:
        return 0, np.full(BITS, 0.5), np.eye(BITS)
    n = summed[0]["n"]
    both = np.zeros(BITS * BITS)
    both[[r["k"] for r in summed]] = [r["c"] / n for r in summed]
    both = both.reshape(BITS, BITS)
    p = np.diag(both).copy()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, p, (both - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into ``m`` partitions of nearly equal size, correlated bits together."""
    left, out = set(range(BITS)), []
    strength = np.abs(correlation) - np.eye(BITS)
    for i in range(m):
        size = len(left) // (m - i)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def close_share(p: np.ndarray, radius: int) -> np.ndarray:
    """Chance that two nodes differ in at most 0, 1 .. radius of these bits, taken as independent."""
    dist = np.zeros(radius + 2)
    dist[0] = 1.0
    for q in 2 * p * (1 - p):
        dist[1:-1], dist[0] = dist[1:-1] * (1 - q) + dist[:-2] * q, dist[0] * (1 - q)
    return np.cumsum(dist[: radius + 1])


def allocate(costs: list[np.ndarray], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (partition unused) with the given sum and the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (paid, chosen) in best.items():
            for t in range(-1, len(cost)):
                price = paid + (0.0 if t < 0 else float(cost[t]))
                if used + t not in then or price < then[used + t][0]:
                    then[used + t] = (price, [*chosen, t])
        best = then
    return best[total]


def plan_partitions(nodes: DataFrame, radius: int, most: int = 6) -> list[tuple[int, list[int]]]:
    """``(bit mask, probe masks)`` of each partition that is used.

    The cost of a threshold is that of its probes plus the expected
    candidates: the number of nodes times the chance of two being that close,
    and what the partition's real population shows above that at distance 0.
    """
    n, p, correlation = bit_statistics(nodes)
    options = {m: group_bits(correlation, m) for m in range(2, min(most, radius + 1) + 1)}
    masks = {(m, i): sum(1 << b for b in bits) for m, parts in options.items() for i, bits in enumerate(parts)}
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in masks.items()}
    keyed = nodes.select(F.explode(F.array(*[F.struct(F.lit(f"{m}.{i}").alias("part"), F.col("fp").bitwiseAND(F.lit(v)).alias("key")) for (m, i), v in signed.items()])).alias("x")).select("x.*")
    met = {r["part"]: r["pairs"] for r in keyed.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    plans = []
    for m, parts in options.items():
        costs = []
        for i, bits in enumerate(parts):
            share = close_share(p[bits], radius)
            real = met.get(f"{m}.{i}", n) / max(n, 1) - 1
            crowd = max(0.0, real - n * share[0])
            balls = np.cumsum([math.comb(len(bits), d) for d in range(radius + 1)]).astype(float)
            costs.append(PROBE_COST * balls + n * share + crowd)
        plans.append((*allocate(costs, radius - m + 1), m))
    _, thresholds, m = min(plans)
    used = []
    for i, t in enumerate(thresholds):
        if t >= 0:
            flips = [0]
            ball = {0}
            for _ in range(t):
                ball |= {x ^ (1 << b) for x in ball for b in options[m][i]}
            flips = sorted(x - (1 << 64) if x >> 63 else x for x in ball)
            used.append((signed[m, i], flips))
    return used


# --- probing ---


def spanning_forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links ``near[i, j]`` between nodes ``a[i]`` and ``b[j]``."""
    open_a, open_b = np.ones(len(a), bool), np.ones(len(b), bool)
    us, vs = [], []
    for start in np.flatnonzero(near.any(axis=1)):
        if not open_a[start]:
            continue
        open_a[start] = False
        front = np.array([start])
        while len(front):
            cols = np.flatnonzero(near[front].any(axis=0) & open_b)
            open_b[cols] = False
            us += a[front[near[front][:, cols].argmax(axis=0)]].tolist() if len(cols) else []
            vs += b[cols].tolist()
            rows = np.flatnonzero(near[:, cols].any(axis=1) & open_a) if len(cols) else np.array([], int)
            open_a[rows] = False
            us += a[rows].tolist()
            vs += b[cols[near[rows][:, cols].argmax(axis=1)]].tolist() if len(rows) else []
            front = rows
    return np.array(us, np.int64), np.array(vs, np.int64)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of fingerprints."""
    return spanning_forest(np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= radius, a, b)


def links(nodes: DataFrame, radius: int = 4, heavy: int = 256, block: int = 1024) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all links within ``radius`` bits."""
    parts = plan_partitions(nodes, radius)
    index = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for i, (mask, _) in enumerate(parts)])).alias("x")).select("x.part", "x.key", "fp")

    def ball(i: int, mask: int, flips: list[int]) -> F.Column:
        key = F.col("fp").bitwiseAND(F.lit(mask))
        return F.transform(F.array(*map(F.lit, flips)), lambda f: F.struct(F.lit(i).alias("part"), key.bitwiseXOR(f.cast("long")).alias("key")))

    crowded = index.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > heavy)
    crowded = materialize(crowded.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "heavy")
    calm = index.join(crowded, ["part", "key"], "left_anti")

    def near(probes: DataFrame) -> DataFrame:
        pairs = calm.join(probes, ["part", "key"])
        return pairs.filter((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)).select(F.col("fp").alias("u"), F.col("other").alias("v"))

    light = near(calm.withColumnRenamed("fp", "other"))  # equal values: nothing but the index is needed
    flipped = [ball(i, mask, [f for f in flips if f]) for i, (mask, flips) in enumerate(parts) if len(flips) > 1]
    if flipped:
        light = light.unionByName(near(nodes.select("fp", F.explode(F.flatten(F.array(*flipped))).alias("x")).select("x.part", "x.key", F.col("fp").alias("other"))))

    # The probes that meet a crowded value come from the ball around that value, so the others are not made again.
    flips = F.array(*[F.array(*map(F.lit, f)).cast("array<long>") for _, f in parts])
    around = crowded.select("part", "key", "blocks", F.explode(F.get(flips, F.col("part"))).alias("flip")).withColumn("at", F.col("key").bitwiseXOR(F.col("flip")))
    met = index.select(F.col("part").alias("in_part"), F.col("key").alias("value"), F.col("fp").alias("other")).join(around, (F.col("in_part") == F.col("part")) & (F.col("value") == F.col("at")))
    met = materialize(met.select("part", "key", "blocks", "other"), "met")
    sizes = met.groupBy("part", "key", "blocks").agg(F.ceil(F.count("*") / block).cast("int").alias("others"))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, ["part", "key"]).withColumn("a", of("fp", "blocks")).withColumn("b", every("others")).select("part", "key", "a", "b", "fp", F.lit(True).alias("own"))
    right = met.join(sizes.drop("blocks"), ["part", "key"]).withColumn("b", of("other", "others")).withColumn("a", every("blocks")).select("part", "key", "a", "b", F.col("other").alias("fp"), F.lit(False).alias("own"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].to_numpy(bool)
        fp = pdf["fp"].to_numpy(np.int64)
        u, v = forest(fp[own], fp[~own], radius)
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    dense = left.unionByName(right).groupBy("part", "key", "a", "b").applyInPandas(compare, "u long, v long")
    return light.unionByName(dense)


def grouped(docs: DataFrame, shingle: int, radius: int, id_col: str, text: str) -> DataFrame:
    """``(id, mark, fp, root, component_id)`` of every row; ``mark`` tells the texts of one id apart."""
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(blank(F.col(text))).alias("mark"), F.col(text).alias("text"))
    prints = materialize(fingerprints(own, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius))
    named = component_names(nodes.withColumnRenamed("fp", "node"), roots)
    return prints.join(named.withColumnRenamed("node", "fp"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint and component: ``(id, fingerprint, component_id)``.

    The component is the smallest id reachable over links of ``radius`` bits
    or fewer. A null or empty text, or one without a word, has fingerprint
    zero and is linked like any other; a very long text is read whole, in
    blocks. Repeated rows each get a row. A null id takes part, but is named as
    a component only where no other id is in it (then null). An empty table
    gives an empty table. Other columns of ``docs`` are not read.
    """
    found = grouped(docs, shingle, radius, id_col, text)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that stay when each near-duplicate group keeps its smallest id.

    :func:`~pixelweave.llm.common.rows_kept` says which row stays where ids are
    null or shared. Any column names may be in use.
    """
    groups = materialize(grouped(docs, shingle, radius, id_col, text).select("id", "mark", F.col("root").alias("group")), "groups")
    return rows_kept(docs, groups, id_col, text)
