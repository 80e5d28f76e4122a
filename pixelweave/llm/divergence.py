"""How the sources of a language differ in their words: a sort-based streaming audit.

A postings stream of ``(lang, term, source, document)`` is sorted and scanned
run by run, twice. First within a task: the words of some documents at a time
are sorted by that key and each run becomes one row, so a word that everybody
uses leaves a task once per source and not once per document. Then over the
corpus: the runs are dealt out by ``(lang, term)``, sorted by the whole key and
scanned again; the scan adds up document frequencies and counts, and emits a
term with the counts of all its sources if enough documents have it.

Terms of a language are dealt into shards of bounded size. Each shard meets the
language's sources once and emits partial sums of the pairs' distances and its
own foremost terms; sums and ranks over shards finish both parts. Everything is
64-bit integer arithmetic: ``floor(10^9 a / b)`` is a long division by steps of
a thousand, exact while ``b`` is below 9 * 10^15.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import blank, discard, forget, give_back, limited, materialize, small_batches

#: A-Z become a-z; all that is neither an ASCII letter nor beyond ASCII parts terms.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Words that are sorted at a time, terms in a shard, sources of one block of pairs: bounds on memory.
SORTED, SHARD, BLOCK = 1_000_000, 20_000, 512
LEAST_DOCS, TOP, SCALE, SMOOTHING = 30, 50, 1_000_000_000, 5
RUNS = "lang string, term string, source string, document long, df long, n long"
KEPT = "lang string, term string, n long, sources array<string>, counts array<long>"


def term_runs(docs: DataFrame) -> DataFrame:
    """``(lang, term, source, document, df, n)``: sorted runs of a task, ``document`` being the first of each."""
    own = docs.select(*[blank(F.col(c)).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("document"))

    def runs(batches):
        forget()
        groups, codes, words = {}, {}, itertools.count()
        held: list[tuple[int, int, np.ndarray]] = []

        class Numbers(dict):
            def __missing__(self, term: bytes) -> int:
                self[term] = out = next(words)
                return out

        terms, size = Numbers(), 0

        def scanned():
            """Sort what is held by (term, group, document) and give a row per run of (term, group)."""
            nonlocal terms, size, words
            lengths = np.array([len(x) for _, _, x in held])
            term = np.concatenate([x for _, _, x in held]).astype(np.int64)
            order = np.argsort(np.array([d for _, d, _ in held]), kind="stable")
            place = np.empty(len(held), np.int64)
            place[order] = np.arange(len(held))
            group = np.repeat(np.array([g for g, _, _ in held], np.int64), lengths)
            key = np.sort((term * len(groups) + group) * len(held) + np.repeat(place, lengths))
            by_doc = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            doc_key = key[by_doc] // len(held)
            by_group = np.flatnonzero(np.concatenate([[True], doc_key[1:] != doc_key[:-1]]))
            first = by_doc[by_group]
            n, df = np.diff(np.append(first, len(key))), np.diff(np.append(by_group, len(by_doc)))
            names, pairs = pa.array(list(terms), pa.binary()).cast(pa.string()), list(groups)
            of_term, of_group = doc_key[by_group] // len(groups), doc_key[by_group] % len(groups)
            documents = np.array([d for _, d, _ in held], np.int64)[order][key[first] % len(held)]
            lang, source = (pa.array([p[k] for p in pairs], pa.string()).take(pa.array(of_group)) for k in (0, 1))
            out = pa.record_batch([lang, names.take(pa.array(of_term)), source, pa.array(documents), pa.array(df.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "term", "source", "document", "df", "n"])
            held.clear()
            words, size = itertools.count(), 0
            terms = Numbers()
            for k in range(0, len(out), 20_000):
                yield out.slice(k, 20_000)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "document", "text")))
            for lang, source, document, text in rows:
                found = (text or b"").translate(TERM_BYTES).split()
                if not found:
                    continue
                group = groups.setdefault((lang, source), len(groups))
                held.append((group, document, np.fromiter(map(terms.__getitem__, found), np.int32, len(found))))
                size += len(found)
                if size >= SORTED:
                    yield from scanned()
        if held:
            yield from scanned()
        codes.clear()
        give_back()

    return own.mapInArrow(runs, RUNS)


def merged_runs(runs: DataFrame, least_docs: int) -> DataFrame:
    """One row per (lang, term) that ``least_docs`` documents have, with its sources and their counts."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["lang", "term", "source", "document"]

    def edges(table: pa.Table, names: list[str]) -> np.ndarray:
        """First rows of the runs of equal ``names``."""
        changed = np.zeros(max(len(table) - 1, 0), bool)
        for c in names:
            values = table.column(c).combine_chunks()
            changed |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.concatenate([[True], changed]))

    def collapsed(table: pa.Table) -> pa.Table:
        """A row per (lang, term, source)."""
        first = edges(table, ["lang", "term", "source"])
        out = table.take(pa.array(first))
        for c in ("df", "n"):
            out = out.set_column(out.schema.get_field_index(c), c, pa.array(np.add.reduceat(table.column(c).to_numpy(), first)))
        return out

    def terms(table: pa.Table) -> pa.RecordBatch:
        first = edges(table, ["lang", "term"])
        df, n = (np.add.reduceat(table.column(c).to_numpy(), first) for c in ("df", "n"))
        keep, held = df >= least_docs, np.diff(np.append(first, len(table)))
        rows = table.filter(pa.array(np.repeat(keep, held)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(held[keep])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks()) for c in ("source", "n")]
        heads = table.take(pa.array(first[keep]))
        return pa.record_batch([heads.column("lang").combine_chunks(), heads.column("term").combine_chunks(), pa.array(n[keep]), *lists], ["lang", "term", "n", "sources", "counts"])

    def scan(batches):
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = collapsed(pa.concat_tables([rest, table]) if rest is not None else table)
            last = int(edges(table, ["lang", "term"])[-1])  # the last run may go on in the next batch
            if last:
                yield terms(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield terms(rest)

    return runs.repartition(n, "lang", "term").sortWithinPartitions(*key).mapInArrow(scan, KEPT)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * count / total)`` for ``count`` up to ``total``, by long division."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def shard_parts(table: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Partial sums of the pairs of a block's sources, and each such source's foremost terms, in one shard of a language."""
    groups = groups.sort_by("source")
    sources, lang = groups.column("source").combine_chunks(), groups.column("lang")[0]
    totals = groups.column("n").to_numpy() + SMOOTHING * groups.column("v").to_numpy()
    whole = int(groups.column("lang_n")[0].as_py()) + SMOOTHING * int(groups.column("v")[0].as_py())
    mine = np.flatnonzero(groups.column("mine").to_numpy(zero_copy_only=False))
    off = np.zeros((len(mine), len(sources)), np.int64)
    of, items, values = [], [], []
    table = table.sort_by("term")
    step = max(1, 4_000_000 // max(len(sources), 1))
    ahead: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in mine]
    for at in range(0, len(table), step):
        part = table.slice(at, step).combine_chunks()
        lists = part.column("sources").combine_chunks()
        counts = np.zeros((len(part), len(sources)), np.int64)
        row = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
        column = pc.index_in(lists.flatten(), value_set=sources).to_numpy()
        counts[row, column] = part.column("counts").combine_chunks().flatten().to_numpy()
        p = share(counts + SMOOTHING, totals[None, :])
        q = share(part.column("n").to_numpy() + SMOOTHING, np.int64(whole))
        for k, g in enumerate(mine.tolist()):
            off[k] += np.abs(p - p[:, g : g + 1]).sum(axis=0)
            good = np.flatnonzero((counts[:, g] > 0) & (p[:, g] > q))
            value = p[good, g] - q[good]
            first = np.argsort(-value, kind="stable")[:top]  # terms are in order, so ties stay in it
            ahead[k].append((good[first] + at, value[first]))
    for k, g in enumerate(mine.tolist()):
        if ahead[k]:
            rows, value = (np.concatenate(x) for x in zip(*ahead[k]))
            first = np.argsort(-value, kind="stable")[:top]
            of.append(np.full(len(first), g))
            items.append(rows[first])
            values.append(value[first])
    others = ~np.eye(len(sources), dtype=bool)[mine]
    pair_of, pair_item = np.repeat(mine, others.sum(axis=1)), np.tile(np.arange(len(sources)), len(mine))[others.ravel()]
    term_of, term_rows = np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)
    names = table.column("term").take(pa.array(term_rows)).combine_chunks() if len(table) else pa.array([], pa.string())
    n = len(pair_of) + len(term_of)
    return pa.table({
        "lang": pa.array([lang.as_py()] * n, pa.string()),
        "source": pa.concat_arrays([sources.take(pa.array(pair_of)), sources.take(pa.array(term_of))]),
        "part": pa.array(["pair"] * len(pair_of) + ["term"] * len(term_of), pa.string()),
        "item": pa.concat_arrays([sources.take(pa.array(pair_item)), names.cast(pa.string())]),
        "value": pa.array(np.concatenate([off[others], *values]).astype(np.int64)),
    })


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from the others, and by which terms.

    Null texts, languages and sources are empty strings. A document is a row,
    so repeated rows count each. A text of any length is one document; its
    words are sorted at once. Ties rank by item. A language without a kept term
    has pairs of distance 0; an empty table gives an empty table. Other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = materialize(merged_runs(term_runs(docs), least_docs), "terms")
    langs = docs.select(*[blank(F.col(c)).alias(c) for c in ("lang", "source")]).groupBy("lang", "source").agg(F.count("*").alias("docs"))
    in_source = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    in_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    known = langs.join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left")
    groups = materialize(known.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")]), "groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("held"), F.max("v").alias("terms"))
    dealt = materialize(sizes.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") / SHARD)).alias("shards"), F.ceil(F.col("held") / BLOCK).alias("blocks")), "shards")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    terms = kept.join(limited(dealt), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards")).withColumn("block", each("blocks")).select("lang", "shard", "block", "term", "n", "sources", "counts")
    met = groups.join(limited(dealt), "lang").withColumn("shard", each("shards")).withColumn("block", each("blocks"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("source"), "blocks") == F.col("block")).select("lang", "shard", "block", "source", "n", "v", "lang_n", "mine")
    keys = ["lang", "shard", "block"]
    parts = terms.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(lambda a, b: shard_parts(a, b, top), "lang string, source string, part string, item string, value long")
    summed = materialize(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence")
    discard(kept, groups, dealt)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).filter(f"part = 'pair' or rank <= {int(top)}")
