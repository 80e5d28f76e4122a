"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Letter n-grams of order 1 to 3 are hashed to ``FEATURES`` dimensions. Document
frequencies are counted over every training text. On a bounded, documented
sample (``SAMPLE`` texts a language) spherical k-means finds several centroids
per language. A text gets the language of the centroid nearest by cosine; if
even that is farther than the language's rejection distance, it is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import limited, materialize, small_batches

FEATURES = 4096
#: Bound on the training texts a language gives to the centroid fit. IDF and counts use all texts.
SAMPLE = 1500
CENTROIDS = 3
ROUNDS = 8
#: A text may be so much farther than nearly all texts of the fit before it is rejected.
SLACK = 0.02
#: Centroids that a text is compared with at a time.
BLOCK = 1024
#: Centroids that are broadcast at once (16 kB each); a model of more is compared part by part.
PART = 2048


def letter_table() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


LETTERS = letter_table()


def feature_ids(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text's letters; other characters are one gap. Empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(LETTERS[points], points, 0)
    if not points.any():
        return np.zeros(0, np.int64)
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    points = np.concatenate([[0], points, [0]])
    one = points * 0x9E3779B1 & 0xFFFFFFFF
    two = (one[:-1] * 31 + points[1:] * 0x85EBCA6B) & 0xFFFFFFFF
    three = (two[:-1] * 31 + points[2:] * 0xC2B2AE35) & 0xFFFFFFFF
    ids = np.concatenate([one[points != 0], two, three])
    return (ids ^ (ids >> 15)) * 0x2C1B3C6D >> 12 & (FEATURES - 1)


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log tf) x idf; a zero row where a text has no letter."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        counts = np.bincount(feature_ids(text), minlength=FEATURES)
        at = np.flatnonzero(counts)
        row = (1 + np.log(counts[at])) * idf[at]
        out[i, at] = row / max(float(np.sqrt((row * row).sum())), 1e-12)
    return out


def inverse_frequencies(training: DataFrame) -> np.ndarray:
    """IDF of every feature over all training texts; a task sends at most ``FEATURES`` rows on."""

    def counts(batches):
        seen, n = np.zeros(FEATURES, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                seen[np.unique(feature_ids(text))] += 1
            n += len(pdf)
        yield pd.DataFrame({"feature": np.arange(-1, FEATURES), "n": np.concatenate([[n], seen])})

    rows = training.select("text").mapInPandas(counts, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(FEATURES + 1)
    for r in rows:
        found[r["feature"] + 1] = r["n"]
    return np.log((found[0] + 1) / (found[1:] + 1)).astype(np.float32) + 1


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Spherical k-means from farthest-first seeds; centroids, and the 99.9 % quantile of the distance."""
    rows = rows[rows.any(axis=1)]
    if not len(rows):
        return np.zeros((0, rows.shape[1]), np.float32), 1.0
    mean = rows.mean(axis=0)
    picks = [int((rows @ mean).argmax())]
    while len(picks) < min(k, len(rows)):
        picks.append(int((rows @ rows[picks].T).max(axis=1).argmin()))
    centers = rows[picks]
    for _ in range(rounds):
        near = (rows @ centers.T).argmax(axis=1)
        centers = np.stack([rows[near == j].sum(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32), float(np.quantile(1 - (rows @ centers.T).max(axis=1), 0.999))


class Model:
    """IDF, and unit centroids with the language and rejection distance of each: a model, or a part of one."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, langs: list[str], reach: np.ndarray) -> None:
        self.idf, self.centers, self.langs, self.reach = idf, centers, langs, reach

    def predict(self, texts) -> pd.DataFrame:
        rows = vectors(texts, self.idf)
        blank = ~rows.any(axis=1)
        if not len(self.langs):
            return pd.DataFrame({"lang_pred": ["und"] * len(rows), "score": 0.0, "rejected": True})
        best, score = np.zeros(len(rows), np.int64), np.full(len(rows), -1.0)
        for k in range(0, len(self.centers), BLOCK):
            cosine = rows @ self.centers[k : k + BLOCK].T
            at = cosine.argmax(axis=1)
            found = cosine[np.arange(len(rows)), at]
            better = found > score
            best[better], score[better] = at[better] + k, found[better]
        score = np.clip(score, 0, 1)
        langs = np.array(self.langs, object)[best]
        langs[blank], score[blank] = "und", 0.0
        return pd.DataFrame({"lang_pred": langs, "score": score, "rejected": blank | (1 - score > self.reach[best] + SLACK)})


class WrittenModel:
    """IDF, and a written table ``(part, lang, center, reach)`` of parts of ``PART`` centroids at most."""

    def __init__(self, idf: np.ndarray, table: DataFrame, parts: int) -> None:
        self.idf, self.table, self.parts = idf, table, parts

    def part(self, k: int) -> Model:
        rows = sorted(self.table.filter(F.col("part") == k).select("lang", "center", "reach").collect(), key=lambda r: (r["lang"], r["center"]))  # PART rows at most
        return Model(self.idf, np.array([r["center"] for r in rows], np.float32).reshape(-1, FEATURES), [r["lang"] for r in rows], np.array([r["reach"] for r in rows]))


def fit_table(training: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> WrittenModel:
    """Learn from ``training(key, text, lang)``; rows with a null language teach nothing.

    Every language gets up to ``centroids`` centroids, 16 kB each. Each
    language's fit draws ``sample`` texts in the mean by the hash of the key and
    takes twice that at most. Languages are dealt into parts in the order of
    their names.
    """
    spark = training.sparkSession
    training = training.filter("lang is not null")
    idf = inverse_frequencies(training)
    shares = materialize(training.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")), "language-shares")
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = training.join(limited(shares), "lang").filter(draw < F.col("share"))

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "text"], na_position="last").head(2 * sample)  # the draw has `sample` in the mean
        centers, reach = cluster(vectors(pdf["text"].tolist(), idf), centroids)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "center": list(centers), "reach": reach})

    made = materialize(picked.select("key", "lang", "text").groupBy("lang").applyInPandas(clustered, "lang string, center array<float>, reach double"), "centroids")
    held = made.groupBy("lang").agg(F.count("*").alias("held"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if made.count() <= PART:
        return WrittenModel(idf, made.withColumn("part", F.lit(0)), 1)
    # More languages than a part holds: names are cut into ranges, numbered within each, and ranges are added up.
    ranged = materialize(held.repartitionByRange(n, "lang").withColumn("range_no", F.spark_partition_id()), "language-ranges")
    own = Window.partitionBy("range_no").orderBy("lang").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("range_no").agg(F.sum("held").alias("held"))
    before = sums.select("range_no", (F.sum("held").over(Window.orderBy("range_no")) - F.col("held")).alias("before"))  # a row per range
    step = PART - centroids + 1  # the last language of a part may reach beyond its last place
    placed = ranged.withColumn("at", F.sum("held").over(own) - F.col("held")).join(F.broadcast(before), "range_no").select("lang", F.floor((F.col("at") + F.col("before")) / step).cast("int").alias("part"))
    table = materialize(made.join(limited(materialize(placed, "language-parts")), "lang"), "centroid-parts")
    return WrittenModel(idf, table, (table.agg(F.max("part")).first()[0] or 0) + 1)


def fit(training: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """The whole model of :func:`fit_table` on the driver, for few languages; more than ``PART`` centroids are refused."""
    made = fit_table(training, centroids, sample)
    if made.parts > 1:
        raise ValueError(f"the model has {made.parts} parts; use fit_table")
    return made.part(0)


def predict(docs: DataFrame, model: Model | WrittenModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, lang_pred, score, rejected)`` of every document, from its text alone.

    ``und`` (score 0, rejected) where the text is null or has no letter, or if
    nothing was learned; of centroids that are equally near the first language
    by name wins. A very long text is read whole. Repeated rows get a row each,
    an empty table an empty table. Other columns are not read. A model of
    several parts is broadcast part by part; each adds a pass over the texts,
    and a text keeps its best.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    kind = docs.schema[id_col].dataType.simpleString()

    def passed(part: Model, carried: list[str]):
        shared = spark.sparkContext.broadcast(part)

        def rows(batches):
            for pdf in batches:
                yield pd.concat([pdf[carried].reset_index(drop=True), shared.value.predict(pdf["text"].tolist())], axis=1)

        return rows

    made = "lang_pred string, score double, rejected boolean"
    if isinstance(model, Model) or model.parts == 1:
        one = model if isinstance(model, Model) else model.part(0)
        return docs.select(id_col, F.col(text).alias("text")).mapInPandas(passed(one, [id_col]), f"{id_col} {kind}, {made}")
    numbered = materialize(docs.select(id_col, F.col(text).alias("text")).withColumn("row_no", F.monotonically_increasing_id()), "numbered-texts")
    found = None
    for k in range(model.parts):
        told = materialize(numbered.mapInPandas(passed(model.part(k), [id_col, "row_no"]), f"{id_col} {kind}, row_no long, {made}").withColumn("part", F.lit(k)), f"languages-{k}")
        found = told if found is None else found.unionByName(told)
    best = found.groupBy("row_no").agg(F.max_by(F.struct(id_col, "lang_pred", "score", "rejected"), F.struct("score", -F.col("part"))).alias("b"))
    return best.select("b.*")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that nothing is learned from: crc32 of the id as text, mod 4, is 2 (a null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fit on the documents that are not held out and predict all of them.

    ``(id, held_out, lang_pred, score, rejected)``. A null id counts as empty
    text for :func:`held_out`; rows with null text or null language teach
    nothing but are predicted. See :func:`predict` for texts without letters,
    ties, repeated rows and empty tables.
    """
    small_batches(docs.sparkSession, 1000)
    model = fit_table(docs.filter(~held_out(id_col)).select(F.col(id_col).alias("key"), "text", "lang"))
    return predict(docs, model, id_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
