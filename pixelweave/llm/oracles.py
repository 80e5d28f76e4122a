"""DuckDB SQL for the corpus queries that SQL can express.

The others are tested against brute force: SimHash links and components (no
XXH64 in SQL), language identification and perplexities (fitted models), token
ids (a tokenizer) and licence scores (they follow the corpus's IDF ranks).
"""

from __future__ import annotations

from pixelweave.llm.mixing import SEEDS
from pixelweave.llm.secret_scan import RULES

OWN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Matches and the pieces between them give the offsets, rule by rule."""
    parts = []
    for k, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS kind_no, '{r.kind}' AS kind, unnest(regexp_extract_all(t, {p})) AS whole, unnest(regexp_extract_all(t, {p}, {r.group})) AS value, unnest(string_split_regex(t, {p})[:-2]) AS before, generate_subscripts(regexp_extract_all(t, {p}), 1) AS n, {r.least} AS least FROM d WHERE regexp_matches(t, {p})"
        )
    told = lambda where: f"coalesce(string_agg(kind || ':' || pos || ':' || until, ',' ORDER BY pos, kind_no){where}, '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
    p AS (SELECT *, sum(length(before) + length(whole)) OVER (PARTITION BY doc_id, kind_no ORDER BY n) AS until FROM m),
    s AS (SELECT doc_id, kind_no, kind, CAST(until - length(whole) AS INT) AS pos, CAST(until AS INT) AS until FROM p WHERE length(value) >= least)
    SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      sha256({told(' FILTER (kind_no < 3)')}) AS base_sha256, {told(' FILTER (kind_no IS NOT NULL)')} AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
WARC = f"""WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM h)
    SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM o"""

LINES = r"""WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    w AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, unnest(list_transform(range(1, len(lines) - 1), lambda i: array_to_string(lines[i:i + 2], chr(10)))) AS w FROM d WHERE len(lines) >= 3),
    g AS (SELECT doc_id, pos, w FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
    l AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM g) WHERE k > 1),
    c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM l) GROUP BY 1)
    SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_removed FROM d LEFT JOIN c USING (doc_id)"""


def shingles(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT {key}, regexp_extract_all({LOWER}, '{OWN_WORD}') AS w FROM {table}) WHERE len(w) >= 5"


LEAKS = f"""WITH b AS ({shingles('benchmark', 'item_id')}), d AS ({shingles('documents', 'doc_id')}), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
    SELECT doc_id, item_id, count(*) / any_value(n) AS containment FROM b JOIN d USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) / any_value(n) >= CAST(0.8 AS DOUBLE)"""


def mixing() -> str:
    uniform = lambda seed: f"CAST('0x' || substr(md5({seed} || ':' || doc_id), 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE)"
    tried = ", ".join(f"sum(CASE WHEN {uniform(s)} < part THEN size ELSE 0 END) + any_value(whole) * any_value(source_size) - any_value(target) AS t{s}" for s in range(SEEDS))
    best = "arg_min(seed, (round(abs(off), 3), seed))"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM z),
    c AS (SELECT *, [3, 1, 2][CAST((rank - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, CAST(2.0 AS DOUBLE) * source_size AS cap FROM r),
    v AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM c WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM v WHERE level * weight <= cap),
    t AS (SELECT v.source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target FROM v, f),
    q AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2) ELSE 0 END AS rate FROM t),
    u AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS part FROM q),
    j AS (SELECT d.doc_id, d.size, u.* FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
    y AS (SELECT source, {tried} FROM j GROUP BY 1),
    s AS (SELECT source, {best} AS seed FROM (SELECT source, unnest(range({SEEDS})) AS seed, unnest([{', '.join(f't{k}' for k in range(SEEDS))}]) AS off FROM y) GROUP BY 1)
    SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN {uniform('seed')} < part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j JOIN s ON j.source IS NOT DISTINCT FROM s.source"""


DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER} AS t FROM documents),
    w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS df FROM w GROUP BY ALL),
    k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30),
    v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(sum(k.n * 0 + c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.n + 5 * v.v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (v.n + 5 * v.v) AS BIGINT) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""


#: CRC-32 has no function in SQL: one step per byte, the 256 table entries made by eight steps each.
CRC = "CAST(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(g))), lambda k: CAST('0x' || substr(hex(encode(g)), 2 * k + 1, 2) AS BIGINT))), lambda acc, b: xor(acc >> 8, t.entry[xor(acc & 255, b) + 1])) AS BIGINT)"
WORDS = f"regexp_extract_all({LOWER}, '{OWN_WORD}')"


def features(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS g FROM (SELECT {key}, {WORDS} AS w FROM {table})"


RESAMPLING = f"""WITH t AS (SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS entry FROM range(256) r(b)),
    fd AS ({features('documents', 'doc_id')}), fb AS ({features('benchmark', 'item_id')}), u AS (SELECT DISTINCT g FROM (SELECT g FROM fd UNION ALL SELECT g FROM fb)),
    h AS (SELECT g, xor({CRC}, 4294967295) % 10000 AS bucket FROM u, t),
    s AS (SELECT bucket, count(*) AS s FROM fd JOIN h USING (g) GROUP BY 1), b AS (SELECT bucket, count(*) AS t FROM fb JOIN h USING (g) GROUP BY 1), n AS (SELECT (SELECT count(*) FROM fd) AS big, (SELECT count(*) FROM fb) AS want),
    gn AS (SELECT r.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (big + 10000) / CAST((coalesce(s, 0) + 1) * (want + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN b USING (bucket), n),
    w AS (SELECT doc_id, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight, count(*) AS n_features FROM fd JOIN h USING (g) JOIN gn USING (bucket) GROUP BY 1),
    x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM documents LEFT JOIN w USING (doc_id)),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS held FROM x WHERE n_features >= 39)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * held // 100 THEN place END AS rank FROM x LEFT JOIN o USING (doc_id)"""


ORACLE = {
    "op3_secret_scan": secret_scan(),
    "op5_warc": WARC,
    "op7_line_dedup": LINES,
    "op8_decontamination": LEAKS,
    "op9_source_mixing": mixing(),
    "op11_source_divergence": DIVERGENCE,
    "op13_importance_resampling": RESAMPLING,
}
