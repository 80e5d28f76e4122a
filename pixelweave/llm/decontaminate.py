"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles. A document is cut into
blocks of each partition's upper size, and every two adjacent blocks are a
window: a passage no longer than a block lies within one window, so containment
of an item turns into a Jaccard similarity that does not fall with the
document's length. Items and windows that share a MinHash value (one row per
band, ``HASHES`` bands) are candidates; the smallest items, for which a hash
could miss, are keyed by all their shingles. Candidates are verified by the
exact share of the item's shingles that stand in the whole document. An item of
fewer words than a shingle is one shingle, its whole word sequence, and is
looked for among the document's sequences of that many words.

Values that no item has are dropped in the task that reads the text, by a bit
table of fixed size; what remains is joined by shuffle or broadcast as Spark
finds fit.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import blank, forget, limited, materialize, small_batches

HASHES = 32
SLOT_BITS = 22
#: Items of up to so many shingles are keyed by all of them.
TINY = 8
#: Bytes of a word stay, with A-Z lowered; all other ASCII parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Letters of scripts that part no words: Thai, Lao, Tibetan, Myanmar, Khmer, kana, bopomofo and Chinese characters.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f\u3031-\u303c\u3041-\u30fa\u30fc-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
UNSPACED_RUN = re.compile(f"[0-9A-Za-z\x80-\U0010ffff]*[{UNSPACED}][0-9A-Za-z\x80-\U0010ffff]*")
UNSPACED_LETTER = re.compile(f"([{UNSPACED}])")
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
MULTIPLIERS = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
PLACES = np.array([0x8CB92BA72F3D8DD7, 0xD1342543DE82EF95, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


class WordHashes(dict):
    """XXH64 of the words met, remembered within a bound while a task runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def parted(run: re.Match) -> str:
    """A run with letters of unspaced scripts: each of these a word of its own, non-ASCII marks and spaces parting words."""
    return UNSPACED_LETTER.sub(r" \1 ", "".join(" " if c > "\x7f" and unicodedata.category(c)[0] in "PSZ" else c for c in run[0]))


def words_of(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii() and HAS_UNSPACED.search(text):
        text = UNSPACED_RUN.sub(parted, text)
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def shingle_hashes(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Hashes of the shingles of ``size`` words, in order, repeats included; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(32))) * PLACES[k % len(PLACES)] + np.uint64(k)
        out ^= out >> np.uint64(29)
    return out


def block_size(n: int) -> int:
    """Upper size of the partition of an item with ``n`` shingles; 1 for the smallest."""
    return 1 if n <= TINY else 1 << int(n - 1).bit_length()


def keyed(values: np.ndarray, size: int, band: int) -> np.ndarray:
    """A MinHash value as a key that tells partitions and bands apart."""
    x = values ^ np.uint64((size * 1000003 + band * 7919 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(30))


def item_keys(shingles: np.ndarray) -> np.ndarray:
    size = block_size(len(shingles))
    if size == 1:
        return keyed(shingles, 1, 0)
    return np.concatenate([keyed((shingles * m).min(keepdims=True), size, j) for j, m in enumerate(MULTIPLIERS)])


def batch_hits(each: list[np.ndarray], sizes: list[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document number, key)`` of the windows of a batch of documents, if the table has the key's slot.

    All documents of the batch go through each hash together. Blocks start
    anew with each document, and two adjacent blocks of one document are a
    window; a document of one block is a window by itself.
    """
    lengths = np.array([len(x) for x in each], np.int64)
    flat = np.concatenate(each) if len(each) else np.zeros(0, np.uint64)
    docs, found = np.repeat(np.arange(len(each)), lengths), []

    def keep(of: np.ndarray, keys: np.ndarray) -> None:
        hit = table[slots(keys)]
        found.append((of[hit], keys[hit]))

    if 1 in sizes:
        keep(docs, keyed(flat, 1, 0))
    larger = [x for x in sizes if x > 1]
    if larger and len(flat):
        size = min(larger)
        blocks = -(-lengths // size)
        number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(np.cumsum(lengths) - lengths, blocks) + size * number
        levels = []  # block size, where the blocks begin in the level below, windows, their documents
        while True:
            of = np.repeat(np.arange(len(each)), blocks)
            number = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            follows = np.flatnonzero(of[1:] == of[:-1])
            alone = np.flatnonzero(np.repeat(blocks, blocks) == 1)
            levels.append((size, starts, np.concatenate([follows, alone]), np.concatenate([follows + 1, alone]), of))
            if size >= max(larger):
                break
            starts, blocks, size = np.flatnonzero(number % 2 == 0), -(-blocks // 2), size * 2
        for j, m in enumerate(MULTIPLIERS):
            least = flat * m
            for size, starts, first, second, of in levels:
                least = np.minimum.reduceat(least, starts)
                if size in larger:
                    keep(of[first], keyed(np.minimum(least[first], least[second]), size, j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def bit_table(spark_rows: DataFrame, column: str) -> np.ndarray:
    """Which of ``2^SLOT_BITS`` slots the keys fall in; its size does not depend on the table's."""
    found = spark_rows.select(F.shiftrightunsigned(column, 64 - SLOT_BITS).cast("int").alias("slot")).distinct().toPandas()["slot"]
    table = np.zeros(1 << SLOT_BITS, bool)
    table[found.to_numpy(np.int64)] = True
    return table


def item_shingles(items: DataFrame, shingle: int, item_col: str, text: str) -> DataFrame:
    """``(item, words, n, shingles, keys)`` of every item with a word; distinct shingles of ``words`` words."""

    def rows(batches):
        known = WordHashes()
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            each = [np.unique(shingle_hashes(w, min(shingle, max(len(w), 1)), known)) for w in words]
            pdf["words"] = [min(shingle, len(w)) for w in words]
            pdf["n"] = [len(x) for x in each]
            pdf["shingles"] = [x.view(np.int64) for x in each]
            pdf["keys"] = [np.unique(item_keys(x)).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in each]
            yield pdf.loc[pdf["n"] > 0, ["item", "words", "n", "shingles", "keys"]]

    kind = items.schema[item_col].dataType.simpleString()
    return items.select(F.col(item_col).alias("item"), F.col(text).alias("text")).mapInPandas(rows, f"item {kind}, words int, n int, shingles array<long>, keys array<long>")


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """``(id, mark, item_id, containment)`` of every document and item with a containment of ``threshold`` or more.

    Words are runs of a-z, 0-9 and non-ASCII after lowering A-Z, but letters of
    scripts without spaces (:data:`UNSPACED`) are words each. The measure is the
    share of the item's distinct shingles that stand anywhere in the document.
    An item of fewer than ``shingle`` words has one shingle, all its words.
    Texts without a word (so null and empty ones) match nothing. Texts of one id are
    told apart by ``mark``; repeated rows count once. An empty table on either
    side gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    known_items = materialize(item_shingles(items, shingle, item_col, text), "items")
    sizes = sorted({block_size(r["n"]) for r in known_items.select("n").distinct().collect()})  # a row per item length
    short = [r["words"] for r in known_items.filter(F.col("words") < shingle).select("words").distinct().orderBy("words").collect()]
    keys = known_items.select("item", F.explode("keys").alias("key"))
    shares = known_items.select("item", "n", F.explode("shingles").alias("shingle"))
    key_slots = spark.sparkContext.broadcast(bit_table(keys, "key"))
    shingle_slots = spark.sparkContext.broadcast(bit_table(shares, "shingle"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(blank(F.col(text))).alias("mark"))
    kind = docs.schema[id_col].dataType.simpleString()

    def hits(batches):
        forget()
        known = WordHashes()
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            each = [shingle_hashes(w, shingle, known) for w in words]
            at, keys = batch_hits(each, sizes, key_slots.value)
            for size in short:  # sequences as long as an item that is shorter than a shingle
                brief = [np.unique(shingle_hashes(w, size, known)) for w in words]
                met_at, met = batch_hits(brief, [1], key_slots.value)
                at, keys = np.concatenate([at, met_at]), np.concatenate([keys, met])
                each = [np.concatenate(x) for x in zip(each, brief)]
            rows = pd.DataFrame({"at": at, "value": keys.view(np.int64)}).drop_duplicates()
            out = [rows.assign(what=0)]
            for i in np.unique(at):  # without a key there is no candidate to verify
                found = np.unique(each[i])
                out.append(pd.DataFrame({"at": i, "value": found[shingle_slots.value[slots(found)]].view(np.int64), "what": 1}))
            out = pd.concat(out)
            if len(out):
                place = out["at"].to_numpy()
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[place], "mark": pdf["mark"].to_numpy()[place], "what": out["what"].to_numpy(), "value": out["value"].to_numpy()})

    met = materialize(own.mapInPandas(hits, f"id {kind}, mark long, what int, value long"), "window-hits")
    candidates = met.filter("what = 0").join(keys, F.col("value") == F.col("key")).select("id", "mark", "item").distinct()
    wanted = candidates.join(shares, "item")
    present = met.filter("what = 1").select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("value")).distinct()
    found = wanted.join(present, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")) & (F.col("shingle") == F.col("value")))
    share = found.groupBy("id", "mark", "item", "n").agg((F.count("*") / F.col("n")).alias("containment"))
    return share.filter(F.col("containment") >= threshold).select(F.col("id").alias(id_col), "mark", F.col("item").alias(item_col), "containment")


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, with all their columns, that contain no item.

    Of rows that share an id only those go whose own text contains one;
    repeated rows stay or go together. Null and empty texts stay, and null ids
    are told apart by their texts. Any other column names may be in use.
    """
    bad = contaminated(docs, items, id_col=id_col, text=text, **how).select(F.col(id_col).alias("of"), F.col("mark").alias("of_mark")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(blank(F.col(text))).alias("mark"))
    return own.join(limited(materialize(bad, "leaks")), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left_anti").select("row.*")
