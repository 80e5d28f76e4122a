"""Licence scans through a positional rare-token index, with DataFrame functions only.

Every text is cut into words once; what is kept of it is a small number per
word, 0 for all words that no template has. Document frequencies of the
template words are counted over every document. The index holds the rarer half
of each notice's words with their offsets. A file's own licence words of the
highest IDF are looked up in it; the postings that they meet are intersected by
relative position, that is by where the notice would begin, and what aligns is
verified word by word over the mandatory key phrase. All this happens within a
file's array of numbers.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import blank, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice, and the part of it (its key phrase) that must stand word by word."""

    label: str
    notice: str
    key: str
    base: bool = False


#: The notices that are looked for. The first three are the base.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "you may not use this file except in compliance with the license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike license", "creative commons attribution sharealike"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "permission to use copy modify and or distribute this software"),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution", "permission is granted to anyone to use this software for any purpose"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software released into the public domain"),
)


def words(text) -> F.Column:
    """The words in order. But for the Kelvin sign, put aside first, ``lower`` makes a notice's letters of A-Z alone."""
    return F.regexp_extract_all(F.lower(F.replace(blank(text), F.lit("\u212a"), F.lit("\u0138"))), F.lit(WORD), F.lit(0))


def numbered(docs: DataFrame, vocabulary: list[str], id_col: str, text: str) -> DataFrame:
    """``(id, mark, n_words, known, numbers)``: each word's place in the vocabulary, from 1, and the distinct ones of them."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(blank(F.col(text))).alias("mark"), words(F.col(text)).alias("words"))
    number = lambda w: F.when(w.isin(vocabulary), F.array_position(known, w)).otherwise(0).cast("short")
    rows = own.select("id", "mark", F.size("words").cast("long").alias("n_words"), F.transform("words", number).alias("numbers"))
    return materialize(rows.select("id", "mark", "n_words", F.array_remove(F.array_distinct("numbers"), F.lit(0).cast("short")).alias("known"), "numbers"), "licence-words")


def document_frequencies(rows: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each template word, over all documents."""
    found = {r["word"]: r["count"] for r in rows.select(F.explode(F.concat(F.array(F.lit(0).cast("short")), "known")).alias("word")).groupBy("word").count().collect()}  # a row per template word
    return found.pop(0, 0), {vocabulary[k - 1]: n for k, n in found.items()}


def by_idf(vocabulary: list[str], n_docs: int, frequency: dict[str, int]) -> list[str]:
    """The template words by falling IDF."""
    return sorted(vocabulary, key=lambda w: (-math.log((n_docs + 1) / (frequency.get(w, 0) + 1)), w))


def postings(templates, vocabulary: list[str], order: list[str]) -> list[tuple]:
    """The positional index as rows of :data:`POSTINGS`, one per template.

    ``posted`` has the rarer half of a notice's words, two at least, and
    ``needed`` all words of its key phrase; each word with its offsets in the
    notice, the rarest word first.
    """
    number, rank, rows = {w: k for k, w in enumerate(vocabulary, 1)}, {w: k for k, w in enumerate(order)}, []
    for k, t in enumerate(templates):
        notice, key = t.notice.split(), t.key.split()
        begin = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        rarest = lambda found: sorted(set(found), key=rank.__getitem__)
        offsets = lambda found, at: [(number[w], [at + i for i, x in enumerate(found) if x == w]) for w in rarest(found)]
        posted = offsets(notice, 0)
        rows.append((k, [number[w] for w in notice], begin, begin + len(key), posted[: max(2, len(posted) // 2)], offsets(key, begin)))
    return rows


POSTINGS = "template int, notice array<short>, begin int, end int, posted array<struct<word:short,offsets:array<int>>>, needed array<struct<word:short,offsets:array<int>>>"


def fixed(value, kind: str) -> F.Column:
    """A constant of any type."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def let(value, body) -> F.Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def looked_up(rows: DataFrame, listed: list[tuple], vocabulary: list[str], order: list[str], rare: int) -> DataFrame:
    """``rows`` with ``template`` and ``wanted``: for each template that a file's rare words point at, the words looked up.

    These are the file's ``rare`` indexed words of the highest IDF, and further
    down as many as the key phrase of each template asks for whose words the
    file all has, so that none of those is missed. A template is pointed at by
    two of the words, or by all words of its key phrase being there.
    """
    number = {w: k for k, w in enumerate(vocabulary, 1)}
    place = {number[w]: k for k, w in enumerate(order)}
    templates_of: list[list[int]] = [[] for _ in range(len(vocabulary) + 1)]
    for template, _, _, _, posted, _ in listed:
        for word, _ in posted:
            templates_of[word].append(template)
    ranks = fixed([-1, *[place[k] for k in range(1, len(vocabulary) + 1)]], "array<int>")
    numbers = fixed([number[w] for w in order], "array<short>")
    indexed = fixed([k for k, found in enumerate(templates_of) if found], "array<short>")
    index = fixed(templates_of, "array<array<int>>")
    phrases = fixed([{"template": x[0], "words": [w for w, _ in x[5]]} for x in listed], "array<struct<template:int,words:array<short>>>")

    rarest = F.transform(F.array_sort(F.transform(F.array_intersect("known", indexed), lambda k: F.get(ranks, k))), lambda r: F.get(numbers, r))
    able = F.filter(phrases, lambda t: F.forall(t["words"], lambda w: F.array_contains("known", w)))
    wanted = lambda able: F.array_distinct(F.concat(F.slice(rarest, 1, rare), F.flatten(F.transform(able, lambda t: F.slice(t["words"], 1, 2)))))
    pointed = lambda words: F.flatten(F.transform(words, lambda w: F.get(index, w)))
    twice = lambda at: F.filter(F.array_distinct(at), lambda k: F.size(F.filter(at, lambda other: other == k)) > 1)
    met = lambda able, words: F.array_distinct(F.concat(F.transform(able, lambda t: t["template"]), let(pointed(words), twice)))
    found = let(able, lambda able: let(wanted(able), lambda words: F.struct(words.alias("wanted"), met(able, words).alias("templates"))))
    return rows.select("*", found.alias("found")).select("*", "found.wanted", F.explode("found.templates").alias("template")).drop("found")


def scan(docs: DataFrame, templates=TEMPLATES, rare: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, hits)`` of every document; a hit is ``struct<at, template, verified, share>``.

    ``at`` is where the notice begins (words from 0; below 0 if its beginning
    is cut off), ``share`` the part of its words that stand in place. A hit is a
    place at which two of the file's looked-up words agree on where the notice
    begins; it is verified if the whole key phrase stands there. No place of a
    key phrase is missed. A null text is empty and has no words; a very long
    text is one row of two bytes a word. Repeated rows get a row each: hits
    belong to an id and its text. Words of equal IDF are taken by their
    spelling. An empty table gives an empty table. Other columns are not read.
    """
    often = Counter(w for t in templates for w in t.notice.split())
    vocabulary = sorted(often, key=lambda w: (-often[w], w))  # the usual words first: numbers are found in this order
    rows = numbered(docs, vocabulary, id_col, text)
    order = by_idf(vocabulary, *document_frequencies(rows, vocabulary))
    listed = postings(templates, vocabulary, order)
    index = docs.sparkSession.createDataFrame(listed, POSTINGS)
    met = looked_up(rows.select("id", "mark", "known", "numbers"), listed, vocabulary, order, rare).join(F.broadcast(index), "template")  # the index is fixed by TEMPLATES
    word_at = lambda i: F.when(i >= 0, F.get("numbers", i))
    places = lambda word: F.filter(F.sequence(F.lit(0), F.size("numbers") - 1), lambda i: F.get("numbers", i) == word)
    starts = lambda x: F.flatten(F.transform(places(x["word"]), lambda p: F.transform(x["offsets"], lambda o: p - o)))
    agrees = lambda at, x: F.exists(x["offsets"], lambda o: F.coalesce(word_at(at + o) == x["word"], F.lit(False)))
    # Of the key phrase all words looked up have to agree, of the rest of the notice two.
    able = F.forall("needed", lambda x: F.array_contains("known", x["word"]))
    by_key = F.when(able, F.filter(starts(F.get("needed", F.lit(0))), lambda at: F.forall(F.slice("needed", 1, 2), lambda x: agrees(at, x)))).otherwise(F.array().cast("array<int>"))
    present = F.filter("posted", lambda x: F.array_contains("wanted", x["word"]))
    in_notice = let(present, lambda found: F.filter(F.array_distinct(F.flatten(F.transform(found, starts))), lambda at: F.size(F.filter(found, lambda x: agrees(at, x))) > 1))
    same = lambda at, i: F.coalesce(word_at(at + i) == F.get("notice", i), F.lit(False))
    verified = lambda at: F.forall(F.sequence("begin", F.col("end") - 1), lambda i: same(at, i))
    share = lambda at: F.size(F.filter(F.sequence(F.lit(0), F.size("notice") - 1), lambda i: same(at, i))) / F.size("notice")
    hit = lambda at: F.struct(at.alias("at"), F.col("template"), verified(at).alias("verified"), share(at).alias("share"))
    hits = met.select("id", "mark", F.transform(F.array_union(by_key, in_notice), hit).alias("hits")).filter(F.size("hits") > 0)
    per_doc = hits.groupBy(F.col("id").alias("of"), F.col("mark").alias("of_mark")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    both = rows.select("id", "mark", "n_words").join(per_doc, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    return both.select("id", "n_words", F.coalesce("hits", F.array().cast("array<struct<at:int,template:int,verified:boolean,share:double>>")).alias("hits"))


def digest(scanned: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Places of base phrases, their labels, all labels and the best share of a notice that stands in place."""
    base = [k for k, t in enumerate(templates) if t.base]
    label = F.array(*[F.lit(t.label) for t in templates])
    sure = F.filter("hits", lambda h: h["verified"])
    of_base = F.filter("hits", lambda h: h["verified"] & h["template"].isin(base))
    starts = F.transform(of_base, lambda h: h["at"].cast("long"))
    named = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.get(label, h["template"])))), ",")
    score = F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))
    return scanned.select(F.col("id").alias("doc_id"), "n_words", F.size(of_base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(of_base).alias("base_labels"), named(sure).alias("labels"), score.alias("score"))
