"""The results of operators that SQL can express, as DuckDB SQL over the whole tables."""

from .quality import ERROR, RISK, RULES, STRATA

# CRC-32 of the decimal text of {0}, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT,
  list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)::UBIGINT[]),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))"""


def crc32(column):
    return _CRC32.format(column)


SEARCH = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
         row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, q.r,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""


def _field(column):
    return (f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')")


def _leaf(text):
    return "sha256(" + " || ".join(
        [_field(c) for c in ("doc_id", "source", "lang", "n_chars")] + [_field(text)]) + ")"


LEVELS = 6  # of sixteen: sources of up to 16 million documents


def _levels(name, keys):
    """Levels of a tree over ``{name}0`` (keys, pos, n, h): runs of sixteen, then their hashes."""
    parts = []
    for k in range(LEVELS):
        parts.append(f"""{name}r{k} AS (
  SELECT {keys}, pos // 16 AS pos, any_value(n) AS n, list(h ORDER BY pos) AS hs
  FROM {name}{k} GROUP BY {keys}, pos // 16)""")
        parts.append(f"""{name}{k + 1} AS (
  SELECT {keys}, pos, (n + 15) // 16 AS n,
         CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{k})""")
    return parts


def _walk(name, keys, start, leaf):
    """From ``start`` (keys, pos, and columns) up: the siblings so far and the folded hash."""
    parts, before = [], start
    for k in range(LEVELS):
        slot = f"(b.pos // {16 ** k} % 16)::BIGINT"
        parts.append(f"""{name}w{k} AS (
  SELECT b.* EXCLUDE ({leaf}, sibs),
         CASE WHEN r.n > 1 THEN b.sibs || array_to_string(hs[:{slot}] || hs[{slot} + 2:], '') ELSE b.sibs END AS sibs,
         CASE WHEN r.n > 1 THEN sha256(array_to_string(hs[:{slot}], '') || b.{leaf} || array_to_string(hs[{slot} + 2:], '')) ELSE b.{leaf} END AS {leaf}
  FROM {before} b JOIN {name}r{k} r ON r.pos = b.pos // {16 ** (k + 1)} AND {" AND ".join(f"r.{c} = b.{c}" for c in keys.split(", "))})""")
        before = f"{name}w{k}"
    return parts, before


def _manifest():
    lower = _levels("d", "key")
    upper = _levels("s", "top")
    first, below = _walk("d", "key", "d0", "bent")
    second, above = _walk("s", "top", "s_start", "bent")
    crc = crc32("doc_id")
    parts = [f"""leaves AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, {_leaf("text")} AS h,
         CASE WHEN {crc} % 5 = 0 THEN {_leaf("bent_text")} ELSE {_leaf("text")} END AS bent
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS bent_text
        FROM documents))""", """d0 AS (
  SELECT *, h AS leaf, '' AS sibs, count(*) OVER (PARTITION BY key) AS n,
         row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves)""",
             *lower, f"""s0 AS (
  SELECT 1 AS top, key, h, count(*) OVER () AS n,
         row_number() OVER (ORDER BY encode(key)) - 1 AS pos FROM d{LEVELS})""", *upper, *first,
             f"""s_start AS (
  SELECT b.doc_id, b.leaf, b.bent, b.sibs, s0.top, s0.pos, s0.h AS subroot
  FROM {below} b JOIN s0 USING (key))""", *second]
    return ("WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root.h AS root, sha256(sibs) AS proof_sha256, bent AS folded_root,
       bent = root.h AS verified
FROM {above}, s{LEVELS} root""")


MANIFEST = _manifest()

_WORDS = r"len(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'))"

TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST,
    sha256(strlen(role) || ':' || role || text)) AS turns FROM turns GROUP BY conv_id),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[:h], []), o.turns[h + 1:]) AS turns
  FROM (SELECT *, ({crc32("conv_id")} % 4)::BIGINT AS h FROM own) o
  LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (
  SELECT conv_id, d, turns[:d] AS p, d = len(turns) AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d > 0 THEN (count(*) - 1) * {_WORDS.format("p[d].text")} ELSE 0 END AS saved
  FROM prefixes GROUP BY p, d),
children AS (SELECT p[:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT p[:k] AS p, saved, leaf FROM (
    SELECT nodes.p, saved, (children.n IS NULL)::BIGINT AS leaf, unnest(range(0, depth + 1)) AS k
    FROM nodes LEFT JOIN children USING (p))),
sums AS (SELECT p, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM above GROUP BY p)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(children.n, 0) AS n_children,
       n_leaves, saved_tokens, a.ends_sha256
FROM nodes a JOIN sums USING (p) LEFT JOIN children USING (p)
LEFT JOIN nodes b ON a.depth > 0 AND b.depth = a.depth - 1 AND b.p = a.p[:a.depth - 1]"""



def _quality():
    q, tests = RISK / len(RULES), (len(STRATA) + 1) * sum(len(cuts) for _, cuts in RULES.values())
    grid = ", ".join(f"('{rule}', {cut!r}::DOUBLE)" for rule, (_, cuts) in RULES.items() for cut in cuts)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {e}" for r, (e, _) in RULES.items()) + " END"
    level = " + ".join(f"(n_words >= {n})::INTEGER" for n in STRATA)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parsed AS (
  SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT r, i, words[i:i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM parsed WHERE len(words) >= 3)),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM windows), range(3) offsets(k)
  WHERE times > 1 GROUP BY r),
measured AS (
  SELECT r, doc_id, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM parsed LEFT JOIN covered USING (r)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {level} AS stratum
  FROM measured),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
cells AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k
  FROM failed JOIN good USING (doc_id), (VALUES {grid}) grid(rule, cutoff)
  WHERE NOT base_failed GROUP BY stratum, rule, cutoff),
certified AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM cells
  WHERE k <= n * {q!r}::DOUBLE AND list_sum(list_transform(range(k + 1), lambda j: exp(
    lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({q!r}::DOUBLE) + (n - j) * ln(1 - {q!r}::DOUBLE)))) <= {ERROR / tests!r}::DOUBLE
  GROUP BY stratum, rule),
over AS (
  SELECT DISTINCT r FROM failed JOIN certified USING (stratum) WHERE {value} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND over.r IS NULL AS kept
FROM failed LEFT JOIN over USING (r)"""


QUALITY = _quality()

ORACLES = {
    "op6_exact_search": SEARCH, "op7_quality_rules": QUALITY, "op12_conversation_trie": TRIE, "op13_merkle_manifest": MANIFEST,
}
