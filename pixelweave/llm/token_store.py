"""Token ids in a content-addressed chunk store.

Writing: every text is encoded to an id stream, a rolling hash over the last
``WINDOW`` ids cuts the stream into chunks, and a chunk's name is the BLAKE2b
digest of its bytes. Chunks and document recipes leave each task as rows of one
table, dealt out by chunk name or by document; each unique chunk is kept once.
Recipes (chunk names and lengths) are then sorted by document id and get their
place in the whole stream; a Merkle root over chunk names is kept per document,
and one over documents per recipe file.

The files below a store's path, all Parquet:

- ``parts/kind=chunk``: ``name`` (16 bytes), ``n`` (ids), ``payload`` (ids as
  little-endian unsigned integers of ``width`` bytes)
- ``recipes``: ``doc_id``, ``start``, ``n_tokens``, ``names`` (16 bytes each), ``lengths`` (4 bytes each),
  ``root``, and the recipe file ``part`` with the document's ``slot`` in it
- ``manifest``: ``part``, ``n_docs``, ``n_tokens``, ``root``, ``width``

Reading: payloads are checked against their names and recipes against their
roots. CRC-32 is linear, so a document's checksum is the XOR of its chunks'
checksums, each shifted by the bytes behind it: no document has to be gathered
in one task for it. :func:`read_ids` gives the ids themselves.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import HELD, blank, forget, fresh_path, give_back, materialize, remove_path, small_batches

END_ID = 2
WINDOW, CUT_BITS, LEAST, MOST = 16, 8, 64, 1024
#: Words that a Python worker remembers during a task, and from task to task: a bound on memory, not on what is encoded.
CACHE, KEPT = 1_000_000, 750_000
#: Texts of each task on which the way by words is held to the tokenizer.
SAMPLES = 4
LOWER_AZ = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Latin-1 letters in lower case, then ASCII marks other than the apostrophe: two pieces of the tokenizer.
PLAIN_WORD = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Byte-level spelling: printable bytes are themselves, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


def keys_of(text: str) -> list[bytes]:
    """The words of a text with A-Z lowered, but not in words that a combining mark is part of: NFC comes before lowering."""
    raw = text.encode("utf-8", "surrogatepass")
    if b"\xcc" not in raw and b"\xcd" not in raw:  # the lead bytes of U+0300 to U+037F; no other mark composes with A-Z
        return raw.translate(LOWER_AZ).split()
    return [w.translate(LOWER_AZ) if w.isascii() else w for w in raw.split()]


class WordEncoder:
    """Ids of a text by way of its words.

    For a tokenizer whose pieces never span white space a text's ids are those
    of its words in turn, so a word is encoded once and remembered. A new word
    of Latin letters goes straight to the model, the marks behind it are a
    piece of their own; other new words are encoded together, with a digit
    between them that marks where each ends. :meth:`fits` says whether a
    tokenizer is of that kind, on fixed samples; whole texts are encoded where
    it is not. :meth:`check` holds real texts to the tokenizer.
    Words that differ in the case of A-Z share their ids, except where a
    combining mark may compose with a letter of one case only.
    """

    def __init__(self, path: str, by_word: bool | None = None) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 65536 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.spelling = byte_letters()
        digit = self.encode("0")
        self.mark = int(digit[0]) if len(digit) == 1 else None
        self.by_word = self.fits() if by_word is None else by_word

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def packed(self, ids) -> bytes:
        width = self.dtype.itemsize
        return b"".join([i.to_bytes(width, "little") for i in ids])

    def trim(self) -> None:
        """Forget all but the words met first, which are the frequent ones."""
        if len(self.known) > KEPT:
            self.known = dict(itertools.islice(self.known.items(), KEPT))

    def fits(self) -> bool:
        probe = "The  quick\nbrown-fox's 12 JUMPS, Été.\tend naïveté!! übergrößen: ÿ x_y (mañana) straße;"
        for text in (probe, probe + " J\u030c H\u0331 W\u030a T\u0308 Y\u030aN"):
            if self.mark is None or self.encode(text) != [i for w in keys_of(text) for i in self.encode(w.decode())]:
                return False
        plain = [m for m in map(PLAIN_WORD.fullmatch, probe.lower().split()) if m]
        return all(self.plain(m) == self.packed(self.encode(m[0])) for m in plain)

    def check(self, texts: list[str]) -> None:
        """Hold the way by words to the tokenizer on real texts; a difference is an error, as earlier ids would be wrong too."""
        for text in [t for t in texts if len(t) <= 5000][:SAMPLES]:
            if self.by_word and self.ids(text).tolist() != self.encode(text):
                raise ValueError("this tokenizer's pieces depend on what stands around a word; encode with by_word=False")

    def plain(self, word: re.Match) -> bytes:
        stem, tail = word[1], word[2]
        if tail and (known := self.known.get(stem.encode())) is not None:
            return known + self.tail(tail)
        spelled = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.spelling)
        ids = self.packed([t.id for t in self.model.tokenize(spelled)])
        if not tail:
            return ids
        self.known[stem.encode()] = ids
        return ids + self.tail(tail)

    def tail(self, tail: str) -> bytes:
        if tail not in self.marks:
            self.marks[tail] = self.packed(self.encode(tail))
        return self.marks[tail]

    def learn(self, fresh) -> None:
        """Remember the ids of new words."""
        if len(self.marks) > CACHE:
            self.marks = {"": b""}
        joined, alone = [], []
        for w in fresh:
            text = w.decode("utf-8", "surrogatepass")
            word = PLAIN_WORD.fullmatch(text if w.isascii() else text.lower())
            if word:
                self.known[w] = self.plain(word)
            elif any(c.isnumeric() for c in text):
                alone.append((w, text))
            else:
                joined.append((w, text))
        for k in range(0, len(joined), 500):
            part = joined[k : k + 500]
            ids = np.array(self.encode(" 0 ".join(t for _, t in part)), self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) != len(part):
                alone += part
                continue
            begin = 0
            for (w, _), end in zip(part, ends.tolist()):
                self.known[w] = ids[begin:end].tobytes()
                begin = end + 1
        for w, text in alone:
            self.known[w] = self.packed(self.encode(text))

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned integers."""
        if not self.by_word or "<|" in text:  # a special token's own spelling
            return np.array(self.encode(text), self.dtype)
        words = keys_of(text)
        found = list(map(self.known.get, words))
        gaps, at = [], -1
        for _ in range(found.count(None)):
            gaps.append(at := found.index(None, at + 1))
        if gaps:
            missing = {words[i] for i in gaps}
            if len(self.known) + len(missing) > CACHE:
                self.trim()
            self.learn(missing)
            for i in gaps:
                found[i] = self.known[words[i]]
        return np.frombuffer(b"".join(found), self.dtype)


@functools.lru_cache(maxsize=2)
def encoder_for(path: str, by_word: bool | None = None) -> WordEncoder:
    """One encoder per Python worker, which keeps its words from task to task."""
    return WordEncoder(path, by_word)


HELD.append(encoder_for)


def gear(width: int = 1 << 16) -> np.ndarray:
    """A 64-bit number per id, by a mixing rule."""
    x = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


GEAR = gear()


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash allows a cut; texts may stand one behind the other, as ``LEAST`` exceeds ``WINDOW``."""
    rolled = GEAR[ids if ids.dtype.itemsize == 2 else ids & np.uint32(0xFFFF)]
    span = 1
    while span < WINDOW:  # after each step the sum spans twice as many ids
        rolled[span:] += rolled[:-span] << np.uint64(span)
        span *= 2
    return np.flatnonzero((rolled >> np.uint64(20)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1


def chunk_ends(marks: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the ids from ``begin`` to ``end``: at marks, ``LEAST`` to ``MOST`` ids long."""
    out, last = [], begin
    for m in [*marks, end]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or (m == end and m > last):
            last = m
            out.append(m)
    return out


def merkle(names: list[bytes]) -> bytes:
    """Root of a binary tree over names; an odd one moves up as it is."""
    level = names or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# --- CRC-32 over GF(2), on arrays ---

POLYNOMIAL = 0xEDB88320


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reflected polynomials modulo the CRC-32 polynomial."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


@functools.lru_cache(maxsize=8)
def powers(level: int) -> np.ndarray:
    """``x^(8 k 256^level)`` for ``k`` from 0 to 255."""
    base = np.array([1 << 23], np.uint32)  # x^8
    for _ in range(8 * level):
        base = times(base, base)
    out = [np.array([1 << 31], np.uint32)]  # 1
    for _ in range(255):
        out.append(times(out[-1], base))
    return np.concatenate(out)


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each checksum adds to that of a stream with ``n_bytes`` more bytes behind it."""
    lengths, place = np.unique(n_bytes.astype(np.int64), return_inverse=True)
    power = np.full(len(lengths), 1 << 31, np.uint32)
    for level in range(8):
        digit = (lengths >> (8 * level)) & 255
        if digit.any():
            power = times(power, powers(level)[digit])
    return times(power[place], crc.astype(np.uint32))


# --- writing ---

FIELDS = ["kind", "k", "n", "payload", "doc_id", "n_tokens", "names", "lengths"]


def encoded_rows(docs: DataFrame, tokenizer: str, id_col: str, text: str, by_word: bool) -> DataFrame:
    """Chunk rows, a chunk once per task at most, and a recipe row per document; every task encodes ``by_word`` or none does."""
    own = docs.select(F.col(id_col).alias("doc_id"), blank(F.col(text)).alias("text"))
    schema = f"kind string, k binary, n int, payload binary, doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, names binary, lengths binary"

    def rows(batches):
        give_back()
        encoder, seen = encoder_for(tokenizer, by_word), set()
        end_id, width = np.array([END_ID], encoder.dtype), encoder.dtype.itemsize
        digest = hashlib.blake2b
        for batch in batches:
            streams, texts = [], batch.column("text").to_pylist()
            if not seen:
                encoder.check(texts)
            for text in texts:
                streams += encoder.ids(text), end_id
            if not streams:
                continue
            lengths = np.fromiter(map(len, streams), np.int64, len(streams))
            bounds = np.concatenate([[0], np.cumsum(lengths[::2] + 1)])
            ids = np.concatenate(streams)
            marks = cut_marks(ids)
            at = np.searchsorted(marks, bounds, "right").tolist()
            marks, bounds, data = marks.tolist(), bounds.tolist(), memoryview(ids.tobytes())
            keys, sizes, payloads, names, parts = [], [], [], [], []
            for begin, end, low, high in zip(bounds, bounds[1:], at, at[1:]):
                own_names, own_parts, last = [], [], begin
                for place in chunk_ends(marks[low:high], begin, end):
                    payload = data[last * width : place * width]
                    name = digest(payload, digest_size=16).digest()
                    own_names.append(name)
                    own_parts.append(place - last)
                    if name not in seen:
                        seen.add(name)
                        keys.append(name)
                        sizes.append(place - last)
                        payloads.append(payload)
                    last = place
                names.append(b"".join(own_names))
                parts.append(np.array(own_parts, "<u4").tobytes())
            if len(seen) > 1_000_000:
                seen.clear()
            ids_type = batch.schema.field("doc_id").type
            m, k = len(names), len(keys)
            if k:
                none = pa.nulls(k, pa.binary())
                yield pa.record_batch([pa.array(["chunk"] * k), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary()), pa.nulls(k, ids_type), pa.array(np.zeros(k, np.int64)), none, none], FIELDS)
            none = pa.nulls(m, pa.binary())
            yield pa.record_batch([pa.array(["recipe"] * m), none, pa.array(np.zeros(m, np.int32)), none, batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(names, pa.binary()), pa.array(parts, pa.binary())], FIELDS)
        encoder.trim()

    return own.mapInArrow(rows, schema)


def write_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", by_word: bool | None = None) -> str:
    """Encode ``docs`` and write the store; its path. Null texts are empty and hold the end id alone.

    Whether texts are encoded by way of their words is decided here, once for
    all tasks, unless ``by_word`` says it.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    path = path or fresh_path(spark, "token-store")
    tokenizer = tokenizer or default_tokenizer()
    rows = encoded_rows(docs, tokenizer, id_col, text, WordEncoder(tokenizer).by_word if by_word is None else by_word)
    # Recipes are dealt out one by one, whatever they hold; only chunks of one name have to meet.
    bucket = F.when(F.col("k").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("k"))
    before = F.lag("k").over(Window.partitionBy("kind", "bucket").orderBy("k"))  # equal names are neighbours; recipes have none
    dealt = rows.withColumn("bucket", bucket).withColumn("before", before).filter("k is null or before is null or k <> before").drop("bucket", "before")
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    small_batches(spark, 20_000)
    recipes = spark.read.schema(rows.schema).parquet(f"{path}/parts").filter("kind = 'recipe'").select("doc_id", "n_tokens", "names", "lengths")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("names")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "names").withColumn("part", F.spark_partition_id())

    def placed(batches):
        forget()  # words are not needed from here on
        start, slot = 0, 0
        for pdf in batches:
            n_tokens = pdf["n_tokens"].to_numpy(np.int64)
            pdf["start"] = start + np.cumsum(n_tokens) - n_tokens
            pdf["slot"] = slot + np.arange(len(pdf))
            pdf["root"] = [merkle([b[i : i + 16] for i in range(0, len(b), 16)]) for b in pdf["names"]]
            start, slot = start + int(n_tokens.sum()), slot + len(pdf)
            yield pdf

    local = materialize(ordered.mapInPandas(placed, "doc_id " + ordered.schema["doc_id"].dataType.simpleString() + ", n_tokens long, names binary, lengths binary, part int, start long, slot long, root binary"), "recipes", f"{path}/local")
    sums = local.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    totals = sorted(sums.collect(), key=lambda r: r["part"])  # one row per recipe file
    ends = np.cumsum([0, *(r["n_tokens"] for r in totals)]).tolist()
    offsets = F.broadcast(spark.createDataFrame([(r["part"], before) for r, before in zip(totals, ends)], "part int, before long"))
    local.join(offsets, "part").withColumn("start", F.col("start") + F.col("before")).select("doc_id", "start", "n_tokens", "names", "lengths", "root", "part", "slot").write.option("compression", "zstd").parquet(f"{path}/recipes")

    def rooted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n_docs": [len(pdf)], "n_tokens": [pdf["n_tokens"].sum()], "root": [merkle(pdf["root"].tolist())], "width": [width]})

    one = store_chunks(spark, path).select((F.length("payload") / F.col("n")).cast("int").alias("width")).first()
    width = one["width"] if one else 2
    local.select("part", "slot", "n_tokens", "root").groupBy("part").applyInPandas(rooted, "part int, n_docs long, n_tokens long, root binary, width int").write.parquet(f"{path}/manifest")
    remove_path(spark, f"{path}/local")
    return path


# --- reading ---


def store_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("k binary, n int, payload binary, kind string").parquet(f"{path}/parts").filter("kind = 'chunk'").select("k", "n", "payload")


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(name, n, crc)`` of every chunk after checking its bytes against its name; raises where they differ."""
    width = (spark.read.parquet(f"{path}/manifest").first() or {"width": 2})["width"]

    def rows(batches):
        for batch in batches:
            payloads, lengths, crc = batch.column("payload"), batch.column("n").to_pylist(), []
            for name, payload, n in zip(batch.column("k").to_pylist(), payloads.to_pylist(), lengths):
                if hashlib.blake2b(payload, digest_size=16).digest() != name or len(payload) != n * width:
                    raise ValueError(f"damaged chunk {name.hex()} in {path}")
                crc.append(zlib.crc32(payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4")))
            yield pa.record_batch([batch.column("k"), batch.column("n"), pa.array(crc, pa.int64())], ["name", "length", "crc"])

    return store_chunks(spark, path).mapInArrow(rows, "name binary, length int, crc long")


def recipe_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(part, slot, name, n, behind)`` per chunk of each document; ``behind``: bytes after it, at 4 an id."""

    def rows(batches):
        for batch in batches:
            names = batch.column("names").to_pylist()
            for place, (joined, root) in enumerate(zip(names, batch.column("root").to_pylist())):
                if merkle([joined[i : i + 16] for i in range(0, len(joined), 16)]) != root:
                    raise ValueError(f"recipe {batch.column('part')[place]}/{batch.column('slot')[place]} of {path} does not match its root")
            count = np.fromiter(map(len, names), np.int64, len(names)) // 16
            n = np.frombuffer(b"".join(batch.column("lengths").to_pylist()), "<u4").astype(np.int64)
            first = np.cumsum(count) - count
            ends = np.cumsum(n)
            done = np.repeat(np.concatenate([[0], ends])[first + count], count)
            of = np.repeat(np.arange(len(names)), count)
            yield pa.record_batch([batch.column("part").take(pa.array(of)), batch.column("slot").take(pa.array(of)), pa.array((np.arange(len(n)) - first[of]).astype(np.int32)), pa.array([x[i : i + 16] for x in names for i in range(0, len(x), 16)], pa.binary()), pa.array(n.astype(np.int32)), pa.array(4 * (done - ends))], ["part", "slot", "seq", "name", "n", "behind"])

    return spark.read.parquet(f"{path}/recipes").select("part", "slot", "names", "lengths", "root").mapInArrow(rows, "part int, slot long, seq int, name binary, n int, behind long")


def verify_store(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, from the store's files.

    Every unique chunk is read and checked once. A missing chunk, or lengths
    that disagree, raise an error when the result is computed.
    """
    joined = recipe_rows(spark, path).join(checked_chunks(spark, path), "name", "left")
    joined = joined.withColumn("crc", F.when(F.col("length") == F.col("n"), F.col("crc")).otherwise(F.raise_error(F.lit("a recipe names a chunk that the store lacks"))))

    @F.pandas_udf("long")
    def moved(crc: pd.Series, behind: pd.Series) -> pd.Series:
        return pd.Series(shifted(crc.to_numpy(np.int64).astype(np.uint32), behind.to_numpy(np.int64)).astype(np.int64))

    sums = joined.select("part", "slot", moved("crc", "behind").alias("crc")).groupBy("part", "slot").agg(F.bit_xor("crc").alias("ids_crc32"))
    return spark.read.parquet(f"{path}/recipes").join(sums, ["part", "slot"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document, rebuilt from recipes and chunks."""
    width = (spark.read.parquet(f"{path}/manifest").first() or {"width": 2})["width"]
    pieces = recipe_rows(spark, path).join(store_chunks(spark, path).withColumnRenamed("k", "name").drop("n"), "name")
    whole = pieces.groupBy("part", "slot").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("chunks"))

    @F.pandas_udf("array<int>")
    def ids(chunks: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(bytes(c["payload"]) for c in x), f"<u{width}").astype(np.int32) for x in chunks])

    return spark.read.parquet(f"{path}/recipes").join(whole, ["part", "slot"]).select("doc_id", "start", ids("chunks").alias("ids"))


def store_and_verify(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Write a store and return what :func:`verify_store` reads back.

    Null or empty texts hold the end id alone; repeated rows are documents of
    their own, in the order of their recipes; null ids come first; an empty
    table gives an empty table. Other columns are not read.
    """
    return verify_store(docs.sparkSession, write_store(docs, path, tokenizer, id_col))
