"""Quality rules with an n-gram perplexity band per language.

A modified Kneser-Ney model (Chen & Goodman, 1999) of order 4 over UTF-16 code
units is counted by Spark on every text. Digits count as one unit; nothing else
is folded, so every script has its own n-grams, a key has exactly 64 bits, and
the model grows with what the corpus holds. It interpolates two estimates that
are counted side by side: one from all texts and, with the larger weight, one
from :func:`reference` texts, so that noise that is frequent stays surprising.
A language without reference texts has the first estimate alone.

The probabilities are stored as arrays sorted by the keys' hashes, in shards of
bounded size. All n-grams that are looked up have been counted, so the stored
numbers hold the whole interpolation and no back-off is walked at look-up. A
model of one shard is broadcast; with more shards the texts are numbered and
written once, each shard is broadcast in turn and gives every text its part of
the sum. The result is the same.

Each document gets its perplexity under its language's model. Bands come from
all documents: median plus or minus ``width`` robust deviations of the log
perplexity, per language. What lies outside is rejected.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pixelweave.llm.common import blank, discard, forget, limited, materialize, small_batches

ORDER, UNIT_BITS = 4, 16
#: Weight of the estimate from reference texts.
TRUST = 0.9
#: N-grams in a shard: 12 bytes each in a broadcast, 16 in a worker.
SHARD_ROWS = 4_000_000
#: N-grams that a task holds before it passes counts on.
HELD_ROWS = 2_000_000
SYMBOLS = b"#*$%&|<>"
#: Places of a log perplexity, which sums in another order do not change, and of those that medians are taken from.
PLACES, MEDIAN_PLACES = 6, 4
UNSEEN = np.float32(-UNIT_BITS * np.log(2))


def ngram_keys(text: str) -> np.ndarray:
    """The order-4 keys of a text, with line ends before it; one per UTF-16 unit, the last unit in the lowest bits."""
    units = np.frombuffer(("\n\n\n" + text).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    units[(units >= 48) & (units <= 57)] = 48
    keys = units[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        keys |= units[ORDER - 1 - k : len(units) - k] << np.uint64(UNIT_BITS * k)
    return keys


def reference(text: str) -> bool:
    """Whether a text counts in the second estimate: 20 words or more, and at most one symbol in ten words."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw.split())
    return n >= 20 and 10 * (len(raw) - len(raw.translate(None, SYMBOLS))) <= n


def language(column) -> F.Column:
    """A language as text that is never null: null is a language of its own."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("="), column))


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts ``(keys, n, r)`` added up by key."""
    keys, n, r = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first), np.add.reduceat(r[order], first)


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of some texts: how often they stand in all and in reference texts."""
    out, blocks, size = [], {True: [], False: []}, 0
    for k, text in enumerate(texts, 1):
        keys = ngram_keys(text)
        blocks[reference(text)].append(keys)
        size += len(keys)
        if size > 1_000_000 or k == len(texts):
            for known, block in blocks.items():
                if block:
                    keys, n = np.unique(np.concatenate(block), return_counts=True)
                    if len(keys):
                        out.append((keys, n, n if known else np.zeros_like(n)))
            blocks, size = {True: [], False: []}, 0
    return out


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``(of, key, n, r)`` over every text of ``docs(of, text)``; each task adds its texts up before the shuffle."""

    def rows(held):
        for of, parts in held.items():
            keys, n, r = summed(parts)
            yield pa.record_batch([pa.array([of] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(r)], ["of", "key", "n", "r"])

    def counts(batches):
        forget()
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for of, text in zip(batch.column("of").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(of, []).append(text)
            for of, some in texts.items():
                for part in counted(some):
                    held.setdefault(of, []).append(part)
                    size += len(part[0])
            if size > HELD_ROWS:
                held = {of: [summed(parts)] for of, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD_ROWS // 2:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    made = docs.select("of", "text").mapInArrow(counts, "of string, key long, n long, r long")
    return made.groupBy("of", "key").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))


def discounts(counts: DataFrame) -> DataFrame:
    """Per language and estimate the three discounts of modified Kneser-Ney, from the counts of counts."""
    of = counts.groupBy("of").agg(*[F.sum(F.when(F.col(c) == k, 1.0).otherwise(0.0)).alias(f"{c}{k}") for c in "nr" for k in (1, 2, 3, 4)])

    def cut(c: str, k: int) -> F.Column:
        y = F.col(f"{c}1") / F.greatest(F.col(f"{c}1") + 2 * F.col(f"{c}2"), F.lit(1.0))
        return F.greatest(F.lit(0.05), F.least(F.lit(k * 0.95), F.lit(float(k)) - (k + 1) * y * F.col(f"{c}{k + 1}") / F.greatest(F.col(f"{c}{k}"), F.lit(1.0))))

    return limited(materialize(of.select("of", *[cut(c, k).alias(f"{c}_d{k}") for c in "nr" for k in (1, 2, 3)]), "discounts"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``(of, key, logp)`` of every n-gram of the highest order: log of the interpolated probability.

    The highest order uses counts, the lower ones the number of distinct units
    seen to the left; below order 1 all units are alike. An estimate that has
    not seen a context leaves it to the next lower order. A context has as
    many rows as units that follow it, 2^16 at most.
    """
    low = lambda bits: F.lit((1 << bits) - 1)
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        shorter = tables[order + 1].groupBy("of", F.col("key").bitwiseAND(low(UNIT_BITS * order)).alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("r"))
        tables[order] = materialize(shorter, f"order{order}-counts")
    lower = None
    for order in range(1, ORDER + 1):
        rows = tables[order].join(discounts(tables[order]), "of").withColumn("context", F.shiftrightunsigned("key", UNIT_BITS))
        context = Window.partitionBy("of", "context")
        if order > 1:
            suffix = F.col("key").bitwiseAND(low(UNIT_BITS * (order - 1)))
            rows = rows.withColumn("suffix", suffix).join(lower.select("of", F.col("key").alias("suffix"), "p_n", "p_r"), ["of", "suffix"])
        else:
            rows = rows.withColumns({"p_n": F.lit(2.0**-UNIT_BITS), "p_r": F.lit(2.0**-UNIT_BITS)})
        for c in "nr":
            d = F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, F.col(f"{c}_d1")).when(F.col(c) == 2, F.col(f"{c}_d2")).otherwise(F.col(f"{c}_d3"))
            total = F.sum(c).over(context)
            rows = rows.withColumn("d", d).withColumn(f"p_{c}", F.when(total > 0, (F.col(c) - F.col("d") + F.sum("d").over(context) * F.col(f"p_{c}")) / total).otherwise(F.col(f"p_{c}")))
        shorter, lower = lower, materialize(rows.select("of", "key", "p_n", "p_r"), f"order{order}")
        if order < ORDER:
            discard(tables[order])
        if shorter is not None:
            discard(shorter)
    taught = counts.groupBy("of").agg(F.lit(TRUST).alias("trust"), F.sum("r").alias("seen")).select("of", F.when(F.col("seen") > 0, F.col("trust")).otherwise(0.0).alias("trust"))
    taught = limited(materialize(taught, "trusts"))
    out = materialize(lower.join(taught, "of").select("of", "key", F.log(F.col("p_n") * (1 - F.col("trust")) + F.col("p_r") * F.col("trust")).cast("float").alias("logp")), "ngram-probabilities")
    discard(lower)
    return out


# --- the stored model ---


def mixed(seeds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams; a seed per language."""
    x = keys ^ seeds
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_of(of: str) -> np.uint64:
    """XXH64 with seed 42, as Spark's ``xxhash64`` gives it."""
    return np.uint64(xxhash.xxh64_intdigest(of.encode("utf-8", "surrogatepass"), 42))


def fit(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The model of ``docs(of, text)``: ``(shard, hashes, logp)``, a row per shard, both arrays sorted by hash."""
    counts = materialize(count_ngrams(docs), "ngrams")
    model = kneser_ney(counts)
    discard(counts)
    made = model.select(F.xxhash64("of").alias("seed"), "key", "logp")
    shards = max(1, -(-made.count() // shard_rows))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = mixed(pdf["seed"].to_numpy(np.int64).view(np.uint64), pdf["key"].to_numpy(np.int64).view(np.uint64))
        order = np.argsort(hashes)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "hashes": [hashes[order].tobytes()], "logp": [pdf["logp"].to_numpy(np.float32)[order].tobytes()]})

    out = materialize(made.withColumn("shard", F.pmod(F.xxhash64("seed", "key"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(packed, "shard int, hashes binary, logp binary"), "ngram-model")
    discard(model)
    return out


class SortedModel:
    """A shard's hashes in order, their log probabilities, and where the hashes of each leading bit pattern begin."""

    def __init__(self, hashes: bytes, logp: bytes) -> None:
        self.hashes, self.logp = np.frombuffer(hashes, np.uint64), np.frombuffer(logp, np.float32)
        self.shift = np.uint64(64 - max(1, int(len(self.hashes)).bit_length()))
        self.begins = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, 0 where the shard lacks the n-gram, and whether it has it."""
        top = (hashes >> self.shift).astype(np.int64)
        at, end = self.begins[top], self.begins[top + 1]
        out, met, left = np.zeros(len(hashes), np.float32), np.zeros(len(hashes), bool), np.flatnonzero(at < end)
        at, end, want = at[left], end[left], hashes[left]
        while len(left):
            hit = self.hashes[at] == want
            met[left[hit]] = True
            out[left[hit]] = self.logp[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            left, at, end, want = left[go], at[go], end[go], want[go]
        return out, met


def text_sums(model: SortedModel, languages: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sum of the log probabilities that the shard has, how many they are, and how many n-grams there are."""
    keys = [ngram_keys(t) for t in texts]
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    sums, met = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
    begin = 0
    while begin < len(keys):  # about a million n-grams at a time
        end = begin + max(1, int(np.searchsorted(np.cumsum(n[begin:]), 1_000_000)))
        seeds = np.repeat(np.array([seed_of(x) for x in languages[begin:end]], np.uint64), n[begin:end])
        logp, hit = model.find(mixed(seeds, np.concatenate(keys[begin:end])))
        ends = np.cumsum(n[begin:end])
        each = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: E731, B023
        sums[begin:end], met[begin:end] = each(logp.astype(np.float64)), each(hit.astype(np.int64))
        begin = end
    return sums, met, n


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, repeated = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated += 1
        elif not line.isspace() and line:
            seen.add(line)
    points = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c")))
    covered = 0
    if n > 8:
        names: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids = np.fromiter(map(names.__getitem__, found), np.int64, n)
        for span in (1, 2, 4):  # names of runs of 2, 4 and 8 words: equal names, equal words
            ids = np.unique(ids[:-span] * n + ids[span:], return_inverse=True)[1]
        twice = np.bincount(ids)[ids] > 1
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.flatnonzero(twice), 1)
        np.add.at(edge, np.flatnonzero(twice) + 8, -1)
        covered = int((np.cumsum(edge[:n]) > 0).sum())
    return n, points, symbols, repeated, covered


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: DataFrame, carried: str) -> DataFrame:
    """Base features and log perplexity of every ``docs(<carried>, of, text)`` row; NaN for an empty text."""
    spark = docs.sparkSession
    schema = lambda more: StructType([docs.schema[carried], *StructType.fromDDL(more)])

    def loaded(shard: int):
        row = model.filter(F.col("shard") == shard).first()
        return spark.sparkContext.broadcast((bytes(row["hashes"]), bytes(row["logp"])) if row else (b"", b""))

    def passed(columns: list[str], shared, with_features: bool):
        def rows(batches):
            forget()
            shard = SortedModel(*shared.value)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                sums, met, n = text_sums(shard, batch.column("of").to_pylist(), texts)
                out = [batch.column(c) for c in columns]
                if with_features:
                    base = np.array([base_features(t) for t in texts], np.int64).reshape(-1, len(FEATURES))
                    out += [pa.array(c) for c in base.T.copy()]
                yield pa.record_batch([*out, pa.array(sums), pa.array(met), pa.array(n)], [*columns, *(FEATURES if with_features else ()), "logp", "met", "n_grams"])

        return rows

    shards = model.agg(F.max("shard")).first()[0] or 0
    kinds = ", ".join(f"{c} long" for c in FEATURES)
    if not shards:
        found = docs.select(carried, "of", "text").mapInArrow(passed([carried, "of"], loaded(0), True), schema(f"of string, {kinds}, logp double, met long, n_grams long"))
    else:
        numbered = materialize(docs.select(carried, "of", "text").withColumn("row_no", F.monotonically_increasing_id()), "numbered-texts")
        found = materialize(numbered.mapInArrow(passed([carried, "of", "row_no"], loaded(0), True), schema(f"of string, row_no long, {kinds}, logp double, met long, n_grams long")), "measured-0")
        sums = found.select("row_no", "logp", "met")
        for k in range(1, shards + 1):
            part = numbered.select("row_no", "of", "text").mapInArrow(passed(["row_no"], loaded(k), False), "row_no long, logp double, met long, n_grams long")
            sums = sums.unionByName(materialize(part.select("row_no", "logp", "met"), f"measured-{k}"))
        found = found.drop("logp", "met").join(sums.groupBy("row_no").agg(F.sum("logp").alias("logp"), F.sum("met").alias("met")), "row_no")
    logp = F.col("logp") + (F.col("n_grams") - F.col("met")) * F.lit(float(UNSEEN))
    return found.select(carried, "of", *FEATURES, F.when(F.col("n_grams") > 0, F.round(-logp / F.col("n_grams"), PLACES)).otherwise(F.lit(float("nan"))).alias("log_perplexity"))


def median(rows: DataFrame, value: F.Column) -> DataFrame:
    """``(of, median)``, exact over values to four places: a language has a row per value, some 100,000 at most."""
    counted = rows.groupBy("of", F.round(value, MEDIAN_PLACES).alias("value")).agg(F.count("*").alias("n"))
    return limited(materialize(counted.groupBy("of").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median")), "medians"))


def bands(measured: DataFrame, width: float, least_width: float) -> DataFrame:
    """``(of, low, high)`` of the log perplexity: median and robust deviation over all sound documents."""
    sound = measured.filter(~F.col("base_failed") & ~F.isnan("log_perplexity"))
    mid = median(sound, F.col("log_perplexity"))
    off = median(sound.join(mid.withColumnRenamed("median", "mid"), "of"), F.abs(F.col("log_perplexity") - F.col("mid")))
    reach = F.greatest(F.col("median") * (1.4826 * width), F.lit(least_width))
    both = mid.withColumnRenamed("median", "mid").join(off, "of")
    return limited(materialize(both.select("of", (F.col("mid") - reach).alias("low"), (F.col("mid") + reach).alias("high")), "bands"))


def judge(docs: DataFrame, width: float = 8.0, least_width: float = 0.2, carried: str = "doc_id", lang: str = "lang", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Features and verdict of every document.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in
    repeated 8-word windows. ``kept``: neither that nor a perplexity outside
    the language's band; a language without a sound document has no band and is
    judged by the base rules alone. A null or empty text has no words and
    fails; a very long text is measured whole, a million n-grams at a time. A
    null language is a language of its own. Repeated rows get a row each, an
    empty table an empty table. Of other columns only ``carried`` is kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(carried), language(F.col(lang)).alias("of"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    model = fit(own, shard_rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = materialize(measure(own, model, carried).withColumn("base_failed", failed), "quality")
    discard(model)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    judged = measured.join(bands(measured, width, least_width), "of", "left").withColumn("kept", ~F.col("base_failed") & inside)
    return judged.select(carried, *FEATURES, "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"), F.expr("nullif(of, '')").substr(2, 1 << 30).alias("lang"))


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that :func:`judge` keeps.

    A verdict follows from text and language alone, so rows are judged under
    two hashes of their text, and only the verdicts of those that go meet the
    rows again, by broadcast behind a count.
    """
    mark = F.struct(F.xxhash64(blank(F.col("text"))).alias("x"), F.hash(blank(F.col("text"))).alias("y"))
    own = docs.select(mark.alias("mark"), "lang", "text")
    bad = judge(own, carried="mark", **how).filter("not kept").select("mark.x", "mark.y", language(F.col("lang")).alias("of")).distinct()
    bad = limited(materialize(bad, "rejected"), 300_000)
    rows = docs.select(F.struct("*").alias("row"), mark.alias("mark"), language(F.col("lang")).alias("own"))
    same = (F.col("mark.x") == F.col("x")) & (F.col("mark.y") == F.col("y")) & (F.col("own") == F.col("of"))
    return rows.join(bad, same, "left_anti").select("row.*")
