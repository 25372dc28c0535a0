"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, conversations, exactdedup, linededup, lm, minhash, mixing, neardup, pieces, quality, sharding, tokencounts, toxicity
from .common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda f: lambda s, d: f(_table(s, d, "documents"))
    with_labels = lambda f: lambda s, d: f(_table(s, d, "documents"), _table(s, d, "labels"))
    return {
        "op1_quality_rules": docs(quality.quality_digest),
        "op2_sharding": docs(sharding.sharding_digest),
        "op3_embedding_neardup": lambda s, d: neardup.near_duplicates(_table(s, d, "embeddings")),
        "op4_mixing": docs(mixing.mixing_digest),
        "op5_token_counts": docs(lambda x: tokencounts.token_digest(x, tokencounts.default_vocabulary())),
        "op6_line_dedup": docs(linededup.line_dedup_digest),
        "op7_minhash_neardup": docs(minhash.minhash_digest),
        "op8_toxicity": with_labels(toxicity.toxicity_digest),
        "op9_sentencepiece": docs(lambda x: pieces.pieces_digest(x, pieces.model_file())),
        "op10_lm_scoring": with_labels(lm.lm_digest),
        "op11_conversation_repair": lambda s, d: conversations.repair(_table(s, d, "conversations")),
        "op12_exact_dedup": docs(exactdedup.exact_digest),
        "op13_alignment": docs(alignment.alignment),
    }


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(quality.RULES))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
         length(t) - length(translate(t, '!', '')) AS n_exclaim,
         len(ls) AS n_lines_with_word, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d LEFT JOIN p USING (doc_id)),
b AS (SELECT *, CAST({bits} AS INTEGER) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (fail_bits & {quality.BASE}) <> 0 AS base_failed, (fail_bits & {quality.POLICIES["v2"]}) = 0 AS kept, fail_bits
FROM b"""


def _mixing_sql() -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         coalesce(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), -1) AS h FROM documents),
o AS (SELECT *, CAST('0x' || substr(md5('11/' || coalesce(CAST(doc_id AS VARCHAR), '\N') || '/' || h || '/0'), 1, 15) AS BIGINT) AS o FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
v AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, 2 * source_size AS cap, 1.5 * (SELECT sum(source_size) FROM s) AS total FROM w),
k AS (SELECT *, row_number() OVER f AS nth, CAST(total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM v WINDOW f AS (ORDER BY cap / weight, place)),
l AS (SELECT arg_min(level, nth) AS level FROM k WHERE level < cap / weight),
t AS (SELECT source, source_size, place, CASE WHEN l.level IS NULL OR cap <= weight * l.level THEN CAST(cap AS DOUBLE) ELSE weight * l.level END AS target
      FROM v LEFT JOIN l ON true),
c AS (SELECT o.doc_id, o.size, t.source_size, t.target, t.place, CAST(round_even(t.target, 0) AS BIGINT) AS demand,
             coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY o, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, greatest(0, least(size, demand - first)) + greatest(0, least(size, demand - first - source_size)) AS taken,
             CAST(first AS DOUBLE) / CAST(demand AS DOUBLE) AS y, [0.5, 0.0, -0.5][place % 3 + 1]::DOUBLE AS a FROM c)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CAST(round_even({mixing.TICKS} * (2.0::DOUBLE * y / ((1.0::DOUBLE - a) + sqrt((1.0::DOUBLE - a) * (1.0::DOUBLE - a) + 4.0::DOUBLE * a * y))), 0) AS BIGINT) END AS position
FROM x"""


_LINES_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT r, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {linededup.MIN_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM a JOIN d USING (r)"""

_VECTORS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= {neardup.THRESHOLD}),
c AS (SELECT x, x AS y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x, min(y) AS low FROM c GROUP BY x),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id"""

_SHINGLES_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS sh FROM g),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * c >= {minhash.PERCENT} * (a.k + b.k - c)),
c AS (SELECT x, x AS y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x, min(y) AS low FROM c GROUP BY x)
SELECT d.doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, coalesce(low, d.doc_id) AS component_id, d.doc_id = coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""

_COPIES_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS k, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, CAST(k AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

_REPAIR_SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: ord(ch)::BIGINT)),
             lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda z, k: xor(z >> 1, 3988292384::BIGINT * (z & 1)))), 4294967295::BIGINT) % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (
  SELECT *, left(role, 1) AS ini, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS after,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM n),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (after IS NOT NULL AND ini || after NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM f GROUP BY conv_id),
m(q, letter, role, q2) AS (VALUES (0, 's', '', 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
w AS (
  SELECT conv_id, rows, 0 AS i, 0 AS q, {'cost': 0, 'audit': '', 'text': []::VARCHAR[]} AS best FROM s
  UNION ALL
  SELECT conv_id, rows, i, q, min(best) FROM (
    SELECT p.conv_id, p.rows, p.i + 1 AS i, CASE WHEN e.edit = 'D' THEN p.q ELSE m.q2 END AS q,
           {'cost': p.best.cost + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': p.best.audit || e.edit,
            'text': CASE e.edit WHEN 'D' THEN p.best.text WHEN 'K' THEN list_append(p.best.text, f.role || ':' || f.text) ELSE list_append(p.best.text, m.role || ':' || f.text) END} AS best
    FROM (
      SELECT w.conv_id, w.rows, w.i, CASE WHEN x = 1 THEN m.q2 ELSE w.q END AS q,
             {'cost': w.best.cost + 2 * x, 'audit': w.best.audit || repeat('I', x), 'text': CASE WHEN x = 1 THEN list_append(w.best.text, m.role || ':') ELSE w.best.text END} AS best
      FROM w CROSS JOIN (VALUES (0), (1)) AS t(x) LEFT JOIN m ON x = 1 AND m.q = w.q AND m.letter <> 's'
      WHERE w.i < w.rows) AS p
    JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    CROSS JOIN (VALUES ('D', 3), ('K', 0), ('R', 2)) AS e(edit, cost)
    LEFT JOIN m ON m.q = p.q AND (e.edit = 'K' AND m.letter = f.ini OR e.edit = 'R' AND m.letter <> 's')
    WHERE e.edit = 'D' OR m.q2 IS NOT NULL AND f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY conv_id, rows, i, q),
r AS (
  SELECT conv_id, min(CASE WHEN q = 2 THEN {'cost': best.cost + 2, 'audit': best.audit || 'I', 'text': list_append(best.text, 'assistant:')} ELSE best END) AS best
  FROM w WHERE i = rows AND q <> 1 GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.text, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle_sql() -> dict[str, str]:
    """Shards (xxhash64, crc32), fitted models and tokenizers have no SQL; brute-force tests cover them."""
    return {
        "op1_quality_rules": _quality_sql(),
        "op3_embedding_neardup": _VECTORS_SQL,
        "op4_mixing": _mixing_sql(),
        "op6_line_dedup": _LINES_SQL,
        "op7_minhash_neardup": _SHINGLES_SQL,
        "op11_conversation_repair": _REPAIR_SQL,
        "op12_exact_dedup": _COPIES_SQL,
    }
