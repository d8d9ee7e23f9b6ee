"""DuckDB SQL for the opN_ queries that SQL can express."""

from quillsieve.llm.language_bayes import BITS, FOLD, MIX
from quillsieve.llm.license_tfidf import CLOSING, GATE, LICENSE_FILE, OPENING, TEMPLATES, WORD

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT k, item_id, q, least(10, len(w)) AS n, array_to_string(list_slice(w, q, q + least(10, len(w)) - 1), ' ') AS gram
      FROM (SELECT k, item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS q FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT o.doc_id, o.n, o.p, g.item_id, g.k, g.q FROM o JOIN g ON o.n = g.n AND o.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id),
run AS (SELECT doc_id, min(p) AS p, count(*) + min(n) - 1 AS l FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, k, p - q ORDER BY p) AS r FROM m) GROUP BY doc_id, k, p - q, r),
l AS (SELECT doc_id, max(l) AS longest, arg_min(p, (-l, p)) - 1 AS longest_at FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(l.longest, 0) AS BIGINT) AS longest, CAST(coalesce(l.longest_at, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def spans_sql(kinds: list[tuple[str, str, str]], base: list[str]) -> str:
    """Spans of regexes (name, RE2 pattern, condition on the match m): the pieces between matches give the positions."""
    parts = []
    for rank, (name, pattern, condition) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS r, '{name}' AS kind, s, e FROM (
  SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, s + length(ms[i]) AS e
  FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM documents))) WHERE {condition}""")
    union = "\nUNION ALL\n".join(parts)
    names = ", ".join(f"'{b}'" for b in base)
    counts = ", ".join(f"CAST(coalesce(n_{b}, 0) AS BIGINT) AS n_{b}" for b in base)
    sums = ", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in base)
    return f"""
WITH s AS ({union}),
a AS (SELECT doc_id, {sums}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (kind IN ({names})) AS base,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(a.base, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""


_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
OP2 = spans_sql(
    [
        ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", "length(regexp_extract(m, '^" + _ASSIGN.replace("'", "''") + "([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
        ("hex", "[0-9a-f]+", "length(m) >= 24"),
        ("private_key", r"-----BEGIN\x20(?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED)\x20)?PRIVATE\x20KEY-----+", "true"),
        ("forge_token", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
        ("chat_token", "xox[abeprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
        ("live_key", "[rs]k_live_[A-Za-z0-9]+", "length(m) >= 24"),
        ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(regexp_extract(m, '[A-Za-z0-9_-]+$', 0)) >= 10"),
    ],
    ["assign", "access", "hex"],
)


OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x
"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _unix(regex: str) -> str:
    """A regex whose line ends are newlines only, as they are in this dialect anyway."""
    return _text(regex.replace("(?md)", "(?m)"))


OP4 = f"""
WITH f AS (SELECT doc_id, text, concat_ws('/', source, doc_id // 1000, CASE WHEN doc_id % 8 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents),
p AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, text, regexp_replace(regexp_replace(text, {_unix(OPENING)}, '', 'g'), {_unix(CLOSING)}, '', 'g') AS bare FROM f),
l AS (SELECT doc_id, path, dir, unnest(list_distinct(list_concat(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_text(GATE)})),
      list_transform(list_filter(string_split_regex(bare, '\n\n+'), lambda x: regexp_matches(x, {_text(GATE)})), lambda x: trim(replace(x, chr(10), ' '))),
      CASE WHEN regexp_matches(path, {_text(LICENSE_FILE)}) THEN [text] ELSE CAST([] AS VARCHAR[]) END))) AS notice FROM p WHERE regexp_matches(text, {_text(GATE)})),
d AS (SELECT notice, count(*) AS n FROM l GROUP BY notice),
t AS (SELECT 't' || i AS template, license, notice FROM (SELECT unnest(range({len(TEMPLATES)})) AS i, unnest([{", ".join(_text(n) for n, _ in TEMPLATES)}]) AS license, unnest([{", ".join(_text(x) for _, x in TEMPLATES)}]) AS notice)),
c AS (SELECT notice, n, word, count(*) AS tf FROM (SELECT notice, n, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS word FROM d) GROUP BY ALL),
g AS (SELECT template, license, word, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS word FROM t) GROUP BY ALL),
s AS (SELECT word, sum(n) AS df FROM (SELECT word, n FROM c UNION ALL SELECT word, 1 FROM g) GROUP BY word),
i AS (SELECT word, ln(((SELECT coalesce(sum(n), 0) FROM d) + {len(TEMPLATES)} + 1.0) / (df + 1.0)) + 1 AS idf FROM s),
w AS (SELECT notice, word, tf * idf AS w FROM c JOIN i USING (word)),
v AS (SELECT template, license, word, tf * idf AS tw FROM g JOIN i USING (word)),
x AS (SELECT notice, license, round(dot / (norm * tnorm), 9) AS cosine FROM (SELECT notice, template, license, sum(w * tw) AS dot FROM w JOIN v USING (word) GROUP BY ALL)
      JOIN (SELECT notice, sqrt(sum(w * w)) AS norm FROM w GROUP BY notice) USING (notice) JOIN (SELECT template, sqrt(sum(tw * tw)) AS tnorm FROM v GROUP BY template) USING (template)),
b AS (SELECT notice, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM x GROUP BY notice HAVING max(cosine) >= 0.6),
h AS (SELECT doc_id, path, dir, b.license, b.cosine FROM l JOIN b USING (notice)),
own AS (SELECT doc_id, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM h GROUP BY doc_id),
held AS (SELECT dir AS above, arg_min(license, (-cosine, license)) AS license, max(cosine) AS cosine FROM h WHERE regexp_matches(path, {_text(LICENSE_FILE)}) GROUP BY dir),
tree AS (SELECT dir, k AS depth, array_to_string(string_split(dir, '/')[1:k], '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM p))),
near AS (SELECT dir, arg_max(above, depth) AS license_dir, arg_max(license, depth) AS license, arg_max(cosine, depth) AS cosine FROM tree JOIN held USING (above) GROUP BY dir)
SELECT p.doc_id, p.path, coalesce(own.license, near.license) AS license, coalesce(own.cosine, near.cosine) AS cosine,
  CASE WHEN own.license IS NOT NULL THEN 'notice' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own.license IS NULL THEN near.license_dir END AS license_dir
FROM p LEFT JOIN own USING (doc_id) LEFT JOIN near ON near.dir = p.dir
"""


# XXH64 in SQL: whole numbers of 128 bits, cut to 64 after each step.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_WORD, _SEED = 2**64 - 1, 42


def _big(n: int) -> str:
    return f"{n % 2**64}::UHUGEINT"


def _mul(a: str, n: int) -> str:
    return f"(({a}) * {_big(n)} & {_big(_WORD)})"


def _rotl(a: str, r: int) -> str:
    """Bits turned round to the left: 2^64 is 1 modulo 2^64 - 1."""
    return f"((({a}) << {r}::UHUGEINT) % {_big(_WORD)})"


def _add(a: str, b: str) -> str:
    return f"((({a}) + {b}) & {_big(_WORD)})"


def _little(x: str, n: int) -> str:
    """The number of n bytes in hexadecimal, least first."""
    return "('0x' || " + " || ".join(f"substr({x}, {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def _round(lane: str) -> str:
    return _mul(_rotl(_mul(lane, _P2), 31), _P1)


def _xxh64(source: str) -> str:
    """CTEs from ``source`` (s) to xd (s, h): XXH64 of the UTF-8 bytes of s, step by step."""
    stripes = []
    for i, init in enumerate((_SEED + _P1 + _P2, _SEED + _P2, _SEED, _SEED - _P1)):
        lanes = f"list_transform(range({i}, n32 * 4, 4), lambda j: eight[j + 1])"
        stripes.append(f"list_reduce(list_prepend({_big(init)}, {lanes}), lambda a, l: {_mul(_rotl(_add('a', _mul('l', _P2)), 31), _P1)}) AS v{i}")
    merged = [f"x{4 + i} AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {_add(_mul(f'xor(h, {_round(f"v{i}")})', _P1), _big(_P4))} ELSE h END AS h) FROM x{3 + i})" for i in range(4)]
    four = _mul(_little("substr(x, 16 * (n // 8) + 1, 8)", 4), _P1)
    one = _mul("('0x' || substr(x, 2 * j + 1, 2))::UBIGINT::UHUGEINT", _P5)
    whole = _add(_add(_add(_rotl("v0", 1), _rotl("v1", 7)), _rotl("v2", 12)), _rotl("v3", 18))
    return f"""x0 AS (SELECT DISTINCT s, hex(encode(s)) AS x, strlen(s) AS n FROM {source}),
x1 AS (SELECT s, x, n, n // 32 AS n32, list_transform(range(0, n // 8), lambda i: {_little("substr(x, 16 * i + 1, 16)", 8)}) AS eight FROM x0),
x2 AS (SELECT *, {", ".join(stripes)} FROM x1),
x3 AS (SELECT *, CASE WHEN n >= 32 THEN {whole} ELSE {_big(_SEED + _P5)} END AS h FROM x2),
{", ".join(merged)},
x8 AS (SELECT s, x, n, list_reduce(list_prepend({_add("h", "n::UHUGEINT")}, list_transform(range(n32 * 4, n // 8), lambda j: {_round("eight[j + 1]")})), lambda a, k: {_add(_mul(_rotl("xor(a, k)", 27), _P1), _big(_P4))}) AS h FROM x7),
x9 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rotl(f"xor(h, {four})", 23), _P2), _big(_P3))} ELSE h END AS h FROM x8),
xa AS (SELECT s, list_reduce(list_prepend(h, list_transform(range(n // 4 * 4, n), lambda j: {one})), lambda a, k: {_mul(_rotl("xor(a, k)", 11), _P1)}) AS h FROM x9),
xb AS (SELECT s, {_mul("xor(h, h >> 33::UHUGEINT)", _P2)} AS h FROM xa),
xc AS (SELECT s, {_mul("xor(h, h >> 29::UHUGEINT)", _P3)} AS h FROM xb),
xd AS (SELECT s, xor(h, h >> 32::UHUGEINT)::UBIGINT AS h FROM xc)"""


OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
{_xxh64("g")},
b AS (SELECT g.doc_id, count(*) AS n, {", ".join(f"sum((h >> {k}) & 1)::BIGINT AS b{k}" for k in range(64))} FROM g JOIN xd USING (s) GROUP BY g.doc_id),
f AS (SELECT d.doc_id, coalesce({" + ".join(f"CASE WHEN 2 * b{k} > n THEN {2**k}::HUGEINT ELSE 0 END" for k in range(64))}, 0)::UBIGINT AS p FROM d LEFT JOIN b USING (doc_id)),
u AS (SELECT p, min(doc_id) AS least FROM f GROUP BY p),
e AS (SELECT a.p AS x, c.p AS y FROM u a JOIN u c ON a.p <> c.p AND bit_count(xor(a.p, c.p)) <= 3),
r AS (SELECT p AS x, p AS y FROM u UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT r.x, min(u.least) AS component_id FROM r JOIN u ON u.p = r.y GROUP BY r.x)
SELECT f.doc_id, lower(lpad(hex(f.p), 16, '0')) AS fingerprint, c.component_id FROM f JOIN c ON c.x = f.p
"""


def _shard(count: int) -> str:
    """arg_max over the shards of -1 / ln(u), u from 52 bits of md5(doc_id|shard)."""
    return f"""(SELECT arg_max(s, -1.0 / ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0))
      FROM range({count}) AS r(s))"""


_CRC = """k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _mixed(x: str) -> str:
    return _mul(x, int(MIX))


OP6 = f"""
WITH {_CRC},
d AS (SELECT doc_id, lang, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda x, y: xor(x >> 8, CAST(t[xor(x & 255, y) + 1] AS BIGINT))), 4294967295) % 3 = 1 AS held_out, coalesce(regexp_matches(text, '\\p{{L}}'), false) AS letter, row_number() OVER () AS r FROM documents, k),
c AS (SELECT r, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT r, regexp_extract_all(text, '(?s).') AS cs FROM d WHERE letter)),
p AS (SELECT r, i, CASE WHEN unicode(c) < {len(FOLD)} AND length(lower(c)) = 1 THEN unicode(lower(c)) ELSE unicode(c) END AS p FROM c),
o AS (SELECT r, p AS p1, lead(p, 1) OVER w AS p2, lead(p, 2) OVER w AS p3 FROM p WINDOW w AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, p1, NULL AS p2, NULL AS p3, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT r, p1, p2, NULL, count(*) FROM o WHERE p2 IS NOT NULL GROUP BY ALL UNION ALL SELECT r, p1, p2, p3, count(*) FROM o WHERE p3 IS NOT NULL GROUP BY ALL),
a1 AS (SELECT p1, p2, p3, {_mixed("p1::UHUGEINT + 1::UHUGEINT")} AS y FROM (SELECT DISTINCT p1, p2, p3 FROM n)),
a2 AS (SELECT p1, p2, p3, xor(y, y >> 31::UHUGEINT) AS h FROM a1),
a3 AS (SELECT p1, p2, p3, h, {_mixed(_add("h", "p2::UHUGEINT + 2::UHUGEINT"))} AS y FROM a2),
a4 AS (SELECT p1, p2, p3, coalesce(xor(y, y >> 31::UHUGEINT), h) AS h FROM a3),
a5 AS (SELECT p1, p2, p3, h, {_mixed(_add("h", "p3::UHUGEINT + 3::UHUGEINT"))} AS y FROM a4),
a6 AS (SELECT p1, p2, p3, CAST(coalesce(xor(y, y >> 31::UHUGEINT), h) >> {64 - BITS}::UHUGEINT AS BIGINT) AS bucket FROM a5),
b AS (SELECT n.r, bucket, sum(n) AS n FROM n JOIN a6 ON n.p1 = a6.p1 AND n.p2 IS NOT DISTINCT FROM a6.p2 AND n.p3 IS NOT DISTINCT FROM a6.p3 GROUP BY ALL),
train AS (SELECT r, lang, letter FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL),
lp AS (SELECT lang, ln((count(*) FILTER (letter) + 1.0) / (sum(count(*) FILTER (letter)) OVER () + count(*) OVER ())) AS prior FROM train GROUP BY lang),
lc AS (SELECT lang, bucket, sum(n) AS n FROM train JOIN b USING (r) GROUP BY ALL),
lt AS (SELECT lang, prior, coalesce((SELECT sum(n) FROM lc WHERE lc.lang = lp.lang), 0) + 0.5 * {1 << BITS} AS total FROM lp),
s AS (SELECT b.r, lt.lang, any_value(prior) + sum(b.n * ln((coalesce(lc.n, 0) + 0.5) / total)) AS score FROM b CROSS JOIN lt LEFT JOIN lc ON lc.lang = lt.lang AND lc.bucket = b.bucket GROUP BY ALL),
m AS (SELECT r, arg_min(lang, (-score, lang)) AS lang, max(score) AS top FROM s GROUP BY r),
q AS (SELECT m.r, any_value(m.lang) AS lang, 1 / sum(exp(s.score - m.top)) AS share FROM m JOIN s USING (r) GROUP BY m.r)
SELECT d.doc_id, d.held_out, coalesce(q.lang, 'und') AS lang_pred, round(coalesce(q.share, 0.0), 6) AS score FROM d LEFT JOIN q USING (r)
"""


OP10 = f"""
WITH {_CRC},
d AS (SELECT doc_id, text, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, {_shard(24)} AS a, {_shard(25)} AS b,
  list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT d.*, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda x, y: xor(x >> 8, CAST(t[xor(x & 255, y) + 1] AS BIGINT))), 4294967295) END AS crc FROM d, k)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(a AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY a ORDER BY doc_id, crc, size) - 1 AS slot, CAST(b AS INTEGER) AS grown_shard FROM c
"""


ORACLES: dict[str, str] = {
    "op2_secrets": OP2,
    "op3_embeddings": OP3,
    "op4_licenses": OP4,
    "op5_decontamination": OP5,
    "op6_language": OP6,
    "op8_simhash": OP8,
    "op10_sharding": OP10,
}
