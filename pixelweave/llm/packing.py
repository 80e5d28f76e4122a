"""Packing documents into sequences by a grouping genetic algorithm on islands.

Texts become token ids; only what is longer than a sequence is cut, its first
piece taking the remainder, so every other piece fills a sequence by itself.
The other pieces are dealt by a hash of their key into cells of bounded size,
and each cell is a bin-packing problem of its own. A population of packings
evolves on each of a cell's islands:

- a packing is an array with the bin of every piece; its fitness is the sum of
  the squared fills over the number of bins, so full bins count most,
- crossover injects some whole well-filled bins of one parent into the other,
  removes the bins that hold a piece twice now, dissolves some of the worst
  filled ones, and best-fits the displaced pieces, longest first,
- after each epoch an island's elite migrates to the next island of its cell.

Islands are rows, an epoch is one pass over them and a written table, so a lost
executor costs an epoch of its islands. What stays badly filled in a cell's
best packing is pooled over all cells, dealt out anew by whole bins, and
evolved once more from those bins: a cell's last bins find partners elsewhere.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import HELD, blank, discard, forget, give_back, limited, materialize, small_batches, spread

END_ID, SPACE = 2, 1024
#: Pieces of a cell in the mean, islands of a cell, packings of an island, epochs, crossovers of an epoch.
CELL, ISLANDS, MEMBERS, EPOCHS, CHILDREN = 4096, 3, 6, 3, 16
#: Share of bins that a crossover injects at most, and dissolves; a bin below this fill is pooled.
INJECTED, DISSOLVED, POOLED = 0.15, 0.03, 0.99
#: Chunks that a Python worker remembers, and characters that are split at a time: bounds on memory.
CACHE, KEPT, SLICE = 700_000, 500_000, 1_000_000

#: The characters that the tokenizer's pattern takes for white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the space before it, or white space up to the one before a word: pieces of the tokenizer never cross these.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A blank that no word follows, and white space within a word.
LOOSE, INNER = re.compile(f" (?![^{WHITE}])"), re.compile(f"[{WHITE}]")
#: Fixed value: the pattern that cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin-1 letters, with the space before them, and ASCII marks behind them other than the apostrophe: two pieces in every library.
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Byte-level spelling: printable bytes are themselves, the others follow from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
SEAM = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Ids of a text by way of its chunks, for a byte-level tokenizer that splits by the usual pattern.

    Such a tokenizer's pieces begin and end within a chunk, so a chunk is
    encoded once and remembered. Whether a tokenizer is of that kind is decided
    from its own settings, alike in every task; whole texts are encoded where
    it is not, and where a text spells a special token. New chunks of Latin
    letters are merged by another library over the same vocabulary, which costs
    a third of the time; all others go to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 65536 else "<u4")
        self.known: dict[str, bytes] = {}  # chunks as they stand
        self.after: dict[str, bytes] = {}  # words behind a blank, with it
        self.by_chunk = self.splits(path)
        self.merge = self.merger(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    @staticmethod
    def splits(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        return said.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    @staticmethod
    def merger(path: str):
        """A faster merge of letters and marks over the file's own vocabulary, where its merges stand in the order of their ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        if model.get("type") != "BPE" or any(vocab.get("".join(m)) != 256 + k for k, m in enumerate(merges)):
            return None
        bytes_of = {chr(c): b for b, c in SPELLING.items()} | {chr(b): b for b in PRINTABLE}
        ranks = {bytes(map(bytes_of.__getitem__, t)): k for t, k in vocab.items() if k < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)

    def made(self, chunk: str) -> bytes:
        """Ids of a new chunk."""
        if self.merge is None or not PLAIN.fullmatch(chunk):
            return self.encode(chunk).tobytes()
        return array(self.dtype.char, self.merge(chunk)).tobytes()

    def learn(self, fresh) -> None:
        if len(self.known) + 2 * len(fresh) > KEPT:
            self.known = dict(itertools.islice(self.known.items(), KEPT // 2))
        for chunk in fresh:
            self.known[chunk] = self.made(chunk)

    def by_chunks(self, text: str) -> bytes:
        chunks = CHUNK.findall(text)
        found = list(map(self.known.get, chunks))
        if None in found:
            self.learn({c for c, x in zip(chunks, found) if x is None})
            found = [self.known[c] if x is None else x for c, x in zip(chunks, found)]
        return b"".join(found)

    def by_blanks(self, text: str) -> bytes:
        """Ids of a text in which every blank is followed by a word: what stands between two blanks goes with the first."""
        head, *words = text.split(" ")
        found = list(map(self.after.get, words))
        if None in found:
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                word = words[at]
                known = self.after.get(word)
                if known is None:
                    if INNER.search(word):
                        known = self.by_chunks(" " + word)
                    else:
                        if len(self.after) >= CACHE:
                            self.after = dict(itertools.islice(self.after.items(), KEPT))
                        known = self.after[word] = self.made(" " + word)
                found[at] = known
        return self.by_chunks(head) + b"".join(found)

    def ids(self, text: str) -> np.ndarray:
        if not self.by_chunk or any(s in text for s in self.special):
            return self.encode(text)
        out, at = [], 0
        while at < len(text):
            seam = SEAM.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = seam.start() if seam else len(text)
            part = text[at:end] if at or end < len(text) else text
            out.append(self.by_chunks(part) if LOOSE.search(part) else self.by_blanks(part))
            at = end
        return np.frombuffer(b"".join(out), self.dtype)


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


HELD.append(encoder_for)


def pieces_of(docs: DataFrame, tokenizer: str, space: int = SPACE, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, id, piece, start, length, ids_crc32)`` and, if asked for, ``ids``, of every piece; ``key`` is its own."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), blank(F.col(text)).alias("text"))

    def rows(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        give_back()
        encoder = encoder_for(tokenizer)
        end, at = np.array([END_ID], encoder.dtype), TaskContext.get().partitionId() << 33
        for batch in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                stream = np.concatenate([encoder.ids(text), end])
                first = (len(stream) - 1) % space + 1
                wide = memoryview(stream.astype("<u4").tobytes())
                bounds = [0, *range(first, len(stream) + 1, space)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    of.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(wide[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(stream[a:b].astype("<u4").tobytes())
            out = [pa.array(np.arange(at, at + len(of))), batch.column("id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            at += len(of)
            yield pa.record_batch([*out, pa.array(ids, pa.binary())] if with_ids else out, ["key", "id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        give_back()

    return own.mapInArrow(rows, f"key long, id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# --- one packing ---


def best_fit(of: np.ndarray, lengths: np.ndarray, todo: np.ndarray, fills: list[int], space: int) -> None:
    """Put each piece of ``todo`` into the fullest bin that has room for it, or a new one; ``of`` and ``fills`` are changed.

    Bins are kept by the room they have left; a bit per room says where there are any.
    """
    rooms: list[list[int]] = [[] for _ in range(space + 1)]
    for b, fill in enumerate(fills):
        rooms[space - fill].append(b)
    some = sum(1 << r for r, held in enumerate(rooms) if held)
    for i, n in zip(todo.tolist(), lengths[todo].tolist()):
        fit = some >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, b = space, len(fills)
            fills.append(0)
        fills[b] += n
        room -= n
        rooms[room].append(b)
        some |= 1 << room
        of[i] = b


def filled(of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(of, lengths, int(of.max()) + 1).astype(np.int64)


def fitness(of: np.ndarray, lengths: np.ndarray, space: int) -> float:
    """Sum of squared fills over the number of bins."""
    fills = filled(of, lengths) / space
    return float((fills * fills).sum() / len(fills))


def packed(lengths: np.ndarray, order: np.ndarray, space: int) -> np.ndarray:
    of = np.zeros(len(lengths), np.int32)
    best_fit(of, lengths, order, [], space)
    return of


def crossover(one: np.ndarray, other: np.ndarray, lengths: np.ndarray, space: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``one`` with whole well-filled bins of ``other``."""
    theirs, mine = filled(other, lengths), filled(one, lengths)
    take = max(1, int(len(theirs) * rng.uniform(0.01, INJECTED)))
    worth = theirs + rng.uniform(0, space / 8, len(theirs))  # the well filled first, not always the same
    injected = np.zeros(len(theirs), bool)
    injected[np.argpartition(-worth, min(take, len(worth)) - 1)[:take]] = True
    moved = injected[other]
    broken = np.zeros(len(mine), bool)
    broken[one[moved]] = True
    broken[np.argsort(mine + rng.uniform(0, space / 8, len(mine)))[: max(1, int(len(mine) * DISSOLVED))]] = True
    displaced = np.flatnonzero(broken[one] & ~moved)
    of = np.where(moved, len(mine) + other, one)
    stays = np.flatnonzero(~(broken[one] & ~moved))
    bins, numbers = np.unique(of[stays], return_inverse=True)
    out = np.zeros(len(of), np.int32)
    out[stays] = numbers
    fills = np.bincount(numbers, lengths[stays], len(bins)).astype(np.int64).tolist() if len(stays) else []
    best_fit(out, lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], fills, space)
    return out


def evolve(lengths: np.ndarray, members: list[np.ndarray], space: int, children: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``children`` crossovers of tournament winners, each taking the worst member's place if it is better; best first."""
    scored = sorted(((fitness(m, lengths, space), k, m) for k, m in enumerate(members)), key=lambda x: (-x[0], x[1]))
    least = -(-int(lengths.sum()) // space)
    for k in range(children):
        if int(scored[0][2].max()) + 1 <= least:  # no packing has fewer bins
            break
        a, b = (min(rng.choice(len(scored), 2, replace=False)) for _ in range(2))
        child = crossover(scored[a][2], scored[b][2] if b != a else scored[(a + 1) % len(scored)][2], lengths, space, rng)
        value = fitness(child, lengths, space)
        if value > scored[-1][0] and all(value != s for s, _, _ in scored):
            scored = sorted([*scored[:-1], (value, len(members) + k, child)], key=lambda x: (-x[0], x[1]))
    return [m for _, _, m in scored]


def founders(lengths: np.ndarray, given: np.ndarray | None, space: int, members: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit of the pieces by falling length, exactly and roughly, and the packing that is there already."""
    out = [] if given is None else [given]
    for k in range(members - len(out)):
        blur = lengths * rng.uniform(1 - 0.08 * k, 1 + 0.08 * k, len(lengths)) if k else lengths
        out.append(packed(lengths, np.argsort(-blur, kind="stable"), space))
    return out


# --- islands ---

ISLAND = "cell long, island int, lengths binary, given binary, members array<binary>, migrant binary, best binary, fitness double"


def epoch(state: DataFrame, space: int, number: int, seed: int) -> DataFrame:
    """Every island takes in its migrant and evolves."""

    def rows(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, r.cell, r.island, number])
                lengths = np.frombuffer(r.lengths, "<i4").astype(np.int64)
                read = lambda x: None if x is None else np.frombuffer(x, "<i4")
                members = [read(m) for m in r.members] if r.members is not None else founders(lengths, read(r.given), space, MEMBERS, rng)
                if r.migrant is not None:
                    members[-1] = read(r.migrant)
                members = evolve(lengths, members, space, CHILDREN, rng)
                told = [m.astype("<i4").tobytes() for m in members]
                yield pd.DataFrame({"cell": [r.cell], "island": [r.island], "lengths": [r.lengths], "given": [None], "members": [told], "migrant": [None], "best": [told[0]], "fitness": [fitness(members[0], lengths, space)]})

    return state.mapInPandas(rows, ISLAND)


def evolved(items: DataFrame, cells: int, deal: str, space: int, seed: int) -> DataFrame:
    """``(key, length, cell, bin, fill, offset)`` from ``items(key, length, bin)``; ``deal`` names what is dealt into cells.

    ``bin`` is the packing there already, or null in every row.
    """
    own = items.withColumn("cell", F.pmod(F.xxhash64(deal, F.lit(seed)), F.lit(cells)).cast("long"))
    held = own.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("order"), "key", "bin"))).alias("items"))
    held = materialize(held, "cells")  # an array of some thousand pieces per cell

    def started(batches):
        for batch in batches:
            lengths, given = [], []
            for x in batch.column("items"):
                own = x.values
                lengths.append((-own.field("order").to_numpy()).astype("<i4").tobytes())
                bins = own.field("bin")
                given.append(None if bins.null_count else np.unique(bins.to_numpy(), return_inverse=True)[1].astype("<i4").tobytes())
            yield pa.record_batch([batch.column("cell"), pa.array(lengths, pa.binary()), pa.array(given, pa.binary())], ["cell", "lengths", "given"])

    first = held.mapInArrow(started, "cell long, lengths binary, given binary").withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("members", "array<binary>"), ("migrant", "binary"), ("best", "binary"), ("fitness", "double"))]
    state = spread(first.select("cell", "island", "lengths", "given", *none), "cell", "island")
    for number in range(EPOCHS):
        done = materialize(epoch(state, space, number, seed), "islands")
        if number:
            discard(before)  # noqa: F821
        before = done
        elites = done.select("cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("best").alias("migrant"))
        state = spread(done.drop("migrant").join(elites, ["cell", "island"]).select(*done.columns), "cell", "island")
    best = done.groupBy("cell").agg(F.max_by("best", F.struct("fitness", -F.col("island"))).alias("best"))

    def placed(batches):
        for batch in batches:
            for cell, x, best in zip(batch.column("cell").to_pylist(), batch.column("items"), batch.column("best").to_pylist()):
                own, of = x.values, np.frombuffer(best, "<i4").astype(np.int64)
                lengths = -own.field("order").to_numpy()
                order = np.argsort(of, kind="stable")
                ends = np.cumsum(lengths[order])
                fills = filled(of, lengths)
                offset = ends - lengths[order] - (np.cumsum(fills) - fills)[of[order]]
                yield pa.record_batch([own.field("key").take(pa.array(order)), pa.array(lengths[order]), pa.array(np.full(len(of), cell)), pa.array(of[order]), pa.array(fills[of[order]]), pa.array(offset)], ["key", "length", "cell", "bin", "fill", "offset"])

    out = materialize(held.join(best, "cell").mapInArrow(placed, "key long, length long, cell long, bin long, fill long, offset long"), "packed")
    discard(held, done)
    return out


def layout(pieces: DataFrame, space: int = SPACE, cell: int = CELL, seed: int = 0) -> DataFrame:
    """``(key, sequence_id, offset)`` of each of the written ``pieces(key, length)``."""
    spark = pieces.sparkSession
    small_batches(spark, 200)
    count = lambda df: -(-df.count() // cell) or 1
    rest = pieces.filter(F.col("length") < space).select("key", "length", F.lit(None).cast("long").alias("bin"))
    first = evolved(rest, count(rest), "key", space, seed)
    poor = F.col("fill") < POOLED * space
    number = lambda wave: (F.col("cell") * (1 << 20) + F.col("bin")) * 2 + wave
    pool = first.filter(poor).select("key", "length", number(0).alias("bin"))
    second = evolved(pool, count(pool), "bin", space, seed + 1)
    small_batches(spark)
    whole = pieces.filter(F.col("length") == space).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    told = lambda df, wave: df.select("key", number(wave).alias("sequence_id"), "offset")
    return whole.unionByName(told(first.filter(~poor), 0)).unionByName(told(second, 1))


def pack(docs: DataFrame, space: int = SPACE, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece, and its ``ids`` if asked for.

    A null or empty text is its end id alone. Repeated rows are documents of
    their own, null ids stay null; texts of any length are cut whole, slice by
    slice of their characters. Equal lengths keep the order of their keys. An
    empty table gives an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    pieces = materialize(pieces_of(docs, tokenizer or default_tokenizer(), space, id_col, text, with_ids), "pieces")
    out = pieces.join(layout(pieces, space), "key").withColumnRenamed("id", id_col)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)`` from what :func:`pack` gives with ids: a sequence's pieces one behind the other."""
    ordered = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return ordered.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
