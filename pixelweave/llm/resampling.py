"""Importance resampling towards a target distribution over hashed n-grams.

The documents' features are counted into buckets and persisted as a sparse
matrix in compressed rows: a table of CSR blocks, each of some thousand
documents. Its column sums are the corpus's distribution, those of the target
texts' matrix the target's; the gain of a bucket is the logarithm of their
ratio. A sparse matrix-vector product with the gains gives the weights, and a
Gumbel draw by them is a range-partitioned sort. What is broadcast is one
number per bucket, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import WIDE_ROWS, discard, forget, give_back, materialize, small_batches

#: A-Z become a-z; ASCII letters, digits and all beyond ASCII make words.
WORD_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Features and documents of a block, words of a document counted at a time, words remembered: bounds on memory.
BLOCK_FEATURES, BLOCK_DOCS, SLICE, CACHE = 100_000, 4096, 250_000, 300_000


class Sums(dict):
    """CRC-32 of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = zlib.crc32(word)
        return out


def byte_table() -> np.ndarray:
    """CRC-32 steps of each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


TABLE = byte_table()


def with_space(crc: np.ndarray) -> np.ndarray:
    """The checksums of texts from which ``crc`` are, with a space behind them."""
    state = ~crc
    return ~(TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def features(words: list[bytes], known: Sums) -> np.ndarray:
    """CRC-32 of every word and of every two neighbours joined by a space; a CRC goes on where that of the first word ended."""
    n = len(words)
    out = np.fromiter(map(known.__getitem__, words), np.uint32, n)
    if n < 2:
        return out
    ahead = with_space(out[:-1]).tolist()
    return np.concatenate([out, np.fromiter(map(zlib.crc32, itertools.islice(words, 1, None), ahead), np.uint32, n - 1)])


def csr_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The document-by-bucket matrix: ``(ids, n_words, ends, columns, counts)`` per block of rows.

    ``ends`` has the number of entries up to the end of each row, ``columns``
    and ``counts`` the entries, as little-endian 32-bit integers (``columns``
    16-bit where they suffice).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def rows(batches):
        forget()
        known = Sums()
        ids, n_words, keys, held, size, ids_type = [], [], [], [], 0, None

        def block():
            """Sort the entries by (row, bucket) and add up equal ones."""
            nonlocal size
            key = np.sort(np.concatenate([*keys, np.zeros(0, np.int64)]))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            entry, n = key[first], np.diff(np.append(first, len(key)))
            if held:  # rows of very long texts were counted by themselves
                more = np.concatenate([k for k, _ in held])
                order = np.argsort(np.concatenate([entry, more]), kind="stable")
                entry, n = np.concatenate([entry, more])[order], np.concatenate([n, *[c for _, c in held]])[order]
            ends = np.searchsorted(entry, np.arange(1, len(ids) + 1) * buckets)
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, ids_type))
            out = pa.record_batch([lists, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(n_words, pa.int64())), one(ends.astype("<i4")), one((entry % buckets).astype(width)), one(n.astype("<i4"))], ["ids", "n_words", "ends", "columns", "counts"])
            for x in (ids, n_words, keys, held):
                x.clear()
            size = 0
            return out

        for batch in batches:
            ids_type = batch.schema.field("id").type
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = (t or b"").translate(WORD_BYTES).split()
                at = len(ids) * buckets
                if len(words) <= SLICE:
                    found = features(words, known) if words else np.zeros(0, np.uint32)
                    keys.append((found % np.uint32(buckets)).astype(np.int64) + at)
                    size += len(found)
                else:
                    total = np.zeros(buckets, np.int64)
                    for k in range(0, len(words), SLICE):  # a slice reaches one word into the next, which counts there alone
                        part = features(words[k : k + SLICE + 1], known)
                        total += np.bincount(part % np.uint32(buckets), minlength=buckets)
                        if k + SLICE < len(words):
                            total[known[words[k + SLICE]] % buckets] -= 1
                    there = np.flatnonzero(total)
                    held.append((there + at, total[there]))
                    size += len(there)
                ids.append(i)
                n_words.append(len(words))
                if size >= BLOCK_FEATURES or len(ids) >= BLOCK_DOCS:
                    yield block()
        if ids:
            yield block()
        give_back()

    return own.mapInArrow(rows, f"ids array<{kind}>, n_words array<long>, ends binary, columns binary, counts binary")


def entries(batch: pa.RecordBatch, buckets: int):
    """``(columns, counts, ends)`` of the blocks of a batch."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    for columns, counts, ends in zip(*(batch.column(c) for c in ("columns", "counts", "ends"))):
        yield tuple(np.frombuffer(x.as_buffer() or b"", kind) for x, kind in ((columns, width), (counts, "<i4"), (ends, "<i4")))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sum of each column; the driver gets ``buckets`` rows."""

    def sums(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for columns, counts, _ in entries(batch, buckets):
                total += np.bincount(columns, counts, buckets).astype(np.int64)  # doubles are exact: a block's entries are bounded
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("columns", "counts", "ends").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of each bucket."""
    big, want, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (big + n) / ((s + 1) * (want + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(blocks: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score)``: the matrix times the gains, over the features of each row, and its Gumbel key."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def key(i) -> float:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def rows(batches):
        for batch in batches:
            for (columns, counts, ends), ids, words in zip(entries(batch, len(gain)), batch.column("ids"), batch.column("n_words")):
                n = np.maximum(2 * words.values.to_numpy() - 1, 0)
                reached = np.concatenate([[0], np.cumsum(gain[columns] * counts)])
                total = np.diff(reached[np.concatenate([[0], ends])])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                score = weight + np.array([key(i) for i in ids.values.to_pylist()], np.int64)
                yield pa.record_batch([ids.values, words.values, pa.array(n), pa.array(weight), pa.array(score)], ["id", "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(rows, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every document; ``rank`` is null for those that are not drawn.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are
    drawn by their scores, ties by id, null ids last; repeated rows are
    documents of their own. A null or empty text has no features, weight 0 and
    is never drawn. Very long texts are counted slice by slice. An empty target
    counts as 0 everywhere; an empty table gives an empty table. Of ``docs``
    only id and text are read, of ``target`` only the text.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    blocks = materialize(csr_blocks(docs, id_col, buckets=buckets), "csr", **WIDE_ROWS)
    wanted = materialize(csr_blocks(target.select(F.lit(0).alias("id"), "text"), "id", buckets=buckets), "csr-target", **WIDE_ROWS)
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("n_words") < least_words, F.desc("score"), F.col("id").asc_nulls_last(), F.col("n_features")]
    dealt = materialize(weighted(blocks, gain, seed).repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id()), "scores")
    discard(blocks, wanted)
    before, at = [], 0
    for r in sorted(dealt.groupBy("range_no").agg(F.count_if(F.col("n_words") >= least_words).alias("n")).collect(), key=lambda r: r["range_no"]):  # a row per range
        before.append((r["range_no"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "range_no int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    ranked = dealt.join(offsets, "range_no").withColumn("place", place)
    drawn = (F.col("n_words") >= least_words) & (F.col("place") <= percent * at // 100)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))
