"""The operators as registered queries over the whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from vektorloom.llm import (
    bpe,
    chat,
    collocations,
    exact_dedup,
    fingerprints,
    html_layout,
    jaccard_join,
    mixing,
    periodic_runs,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
)
from vektorloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.grouped(table(spark, sf_dir, "documents"), jaccard_join.Rule(words=3, part=9, of=10))


@query
def op2_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprinted_edits(table(spark, sf_dir, "documents"))


@query
def op4_html_extraction(spark, sf_dir):
    return html_layout.visible_text(table(spark, sf_dir, "pages"))


@query
def op5_byte_level_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: A conversation whose texts look like the template itself (fixed values).
ODD_TEXT = r"\### Assistant: </turn> ok"


@query
def op9_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(turns.unionByName(odd)))


_ESCAPED = "{0}"
for _plain, _escaped in chat.ESCAPES:
    _quoted = [part.replace("\n", "' || chr(10) || '") for part in (_plain, _escaped)]
    _ESCAPED = f"replace({_ESCAPED}, '{_quoted[0]}', '{_quoted[1]}')"

ORACLES["op9_chat_formatting"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{ODD_TEXT}'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(chat.HEAD) + len(chat.COLON) + len(chat.END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM whole
"""


@query
def op10_mixing(spark, sf_dir):
    return mixing.sampled(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 9) for c in ("weight", "probability", "draw")})


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


# equal stretches of 16 words stand in every run of 24 words and three periods; the checksum is a fold over bytes and bits
ORACLES["op11_periodic_runs"] = r"""
WITH said AS (
  SELECT row_number() OVER () AS row, doc_id, CAST(doc_id AS VARCHAR) AS s,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sums AS (
  SELECT row, doc_id, w, len(w) AS n, xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(s) + 1),
        lambda i: [ascii(s[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END),
    4294967295) AS h
  FROM said
), shape AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM sums),
texts AS (
  SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM shape
), places AS (SELECT row, n, w, unnest(range(0, n)) AS i FROM texts),
grams AS (SELECT row, n, i, array_to_string(w[i + 1:i + 16], ' ') AS gram FROM places WHERE i + 16 <= n),
equal AS (
  SELECT x.row, x.i, y.i - x.i AS period FROM grams x JOIN grams y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i
  WHERE 3 * (y.i - x.i) <= x.n
), numbered AS (SELECT *, i - row_number() OVER (PARTITION BY row, period ORDER BY i) AS stretch FROM equal),
stretches AS (
  SELECT row, period, min(i) AS start, max(i) - min(i) + 16 + period AS length FROM numbered GROUP BY row, period, stretch
), long AS (SELECT * FROM stretches WHERE length >= greatest(24, 3 * period)),
runs AS (
  SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long s WHERE s.row = r.row AND s.period < r.period
    AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
), best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY length::DOUBLE / period DESC, start, period) = 1),
lines AS (
  SELECT row, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS said
  FROM runs GROUP BY row
), dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT p.row, string_agg(p.w[p.i + 1], ' ' ORDER BY p.i) AS said
  FROM places p LEFT JOIN dropped d ON d.row = p.row AND d.i = p.i WHERE d.i IS NULL GROUP BY p.row
)
SELECT t.doc_id, coalesce(l.n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
  CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.said, '')) AS runs_sha256, sha256(coalesce(k.said, '')) AS collapsed_sha256
FROM texts t LEFT JOIN best b ON b.row = t.row LEFT JOIN lines l ON l.row = t.row LEFT JOIN kept k ON k.row = t.row
"""


@query
def op12_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM said),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM places, range(1, 5) AS sizes(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL
), frequent AS (SELECT * FROM grams WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.p, c.k AS size, c.f AS a, x.k AS k, x.f AS l, y.f AS r,
    (2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f::HUGEINT) AS score
  FROM frequent c
  JOIN frequent x ON x.lang = c.lang AND x.k < c.k AND c.p[1:x.k] = x.p
  JOIN frequent y ON y.lang = c.lang AND y.k = c.k - x.k AND c.p[x.k + 1:] = y.p
  WHERE c.k > 1
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (
  SELECT lang, p[s:s + size - 1] AS p, max(f) AS within
  FROM frequent, range(2, 4) AS sizes(size), range(1, 4) AS starts(s)
  WHERE size < k AND s + size - 1 <= k GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
ranked AS (
  SELECT w.lang, array_to_string(w.p, ' ') AS phrase, w.a, w.l, w.r, w.score,
    row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, array_to_string(w.p, ' ')) AS rank
  FROM weakest w LEFT JOIN held h ON h.lang = w.lang AND h.p = w.p
  WHERE h.within IS NULL OR 100::HUGEINT * h.within < 80::HUGEINT * w.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


@query
def op13_quality_rules(spark, sf_dir):
    return quality_rules.kept(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
