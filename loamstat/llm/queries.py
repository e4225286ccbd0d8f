"""Registered queries of the subpackage and their SQL, by operator number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstat.llm.chat_format import digests, format_conversations
from loamstat.llm.collocations import collocations
from loamstat.llm.common import table
from loamstat.llm.decontamination import contamination
from loamstat.llm.jaccard_join import jaccard_components
from loamstat.llm.license_scan import license_scan
from loamstat.llm.media_chunks import media_features
from loamstat.llm.merkle_manifest import document_leaves, verify
from loamstat.llm.mixing import mix_sources
from loamstat.llm.quality import quality_scores
from loamstat.llm.token_counts import token_attribution
from loamstat.llm.token_files import tokens_of
from loamstat.llm.toxicity import toxicity_scores
from loamstat.llm.warc import derivatives

OP6_SHINGLE, OP6_NUM, OP6_DEN = 3, 9, 10


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_control_strings(turns: DataFrame) -> DataFrame:
    """Adds conversation -7, whose texts hold the template's own marks."""
    said = r"\### Assistant: </turn> ok"
    extra = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_conversations(with_control_strings(table(spark, sf_dir, "conversations"))))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"), responses=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), OP6_SHINGLE, OP6_NUM, OP6_DEN)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id's crc32 is divisible by 7 is tampered with: its n_chars grows by 1."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return verify(document_leaves(table(spark, sf_dir, "documents"), tampered, ("n_chars", F.col("n_chars") + 1)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_chat_formatting,
        op3_warc_derivatives,
        op4_token_counts,
        op5_quality,
        op6_ngram_jaccard_join,
        op7_license_scan,
        op8_mixing,
        op9_decontamination,
        op10_media_chunks,
        op11_token_files,
        op12_collocations,
        op13_merkle_manifest,
    )
}

_OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *,
    replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') AS etext,
    replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), chr(10), '\n') AS erole
  FROM turns
), glued AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(etext) + length(erole) + 13) AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM glued
"""

_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reach)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM c GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT item_id, least(10, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p, ws FROM i WHERE len(ws) > 0
), win AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM iw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, ws FROM d, ks WHERE len(ws) >= k
), occ AS (
  SELECT doc_id, item_id, p, win.k FROM (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g FROM dw) x JOIN win ON win.k = x.k AND win.g = x.g
), hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
cf AS (SELECT w, count(*) AS n FROM tok GROUP BY w),
pw AS (SELECT g, string_split(g, ' ') AS gw FROM (SELECT DISTINCT g FROM win)),
tw AS (SELECT g, w, min(place) AS place FROM (SELECT g, unnest(gw) AS w, unnest(range(1, len(gw) + 1)) AS place FROM pw) GROUP BY g, w),
rk AS (SELECT g, tw.w, place, row_number() OVER (PARTITION BY g ORDER BY coalesce(n, 0), tw.w) AS r FROM tw LEFT JOIN cf ON cf.w = tw.w),
pr AS (SELECT a.g, a.w AS w0, b.w AS w1, b.place - a.place AS gap FROM rk a LEFT JOIN rk b ON b.g = a.g AND b.r = 2 WHERE a.r = 1),
up AS (SELECT w0, w1, gap, count(*) AS n FROM pr GROUP BY w0, w1, gap),
nr AS (
  SELECT doc_id, sum(n) AS n_near FROM (
    SELECT DISTINCT x.doc_id, w0, w1, gap, up.n FROM up JOIN tok x ON x.w = w0 JOIN tok y ON y.w = w1 AND y.doc_id = x.doc_id WHERE abs(y.pos - x.pos - gap) <= 3
    UNION ALL SELECT DISTINCT x.doc_id, w0, w1, gap, up.n FROM up JOIN tok x ON x.w = w0 WHERE w1 IS NULL
  ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id LEFT JOIN nr ON nr.doc_id = d.doc_id
"""

_OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (
  SELECT lang, m, g, count(*) AS c FROM (
    SELECT lang, m, array_to_string(ws[p:p + m - 1], ' ') AS g FROM (
      SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS p FROM pieces, range(1, 5) t(m) WHERE len(ws) >= m
    )
  ) GROUP BY lang, m, g HAVING count(*) >= 30
), cand AS (SELECT lang, m, g, c AS a, string_split(g, ' ') AS gw FROM f WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
parts AS (
  SELECT cuts.lang, cuts.g, cuts.a, k, x.c AS l, y.c AS r, CAST(2000000::HUGEINT * cuts.a // (x.c::HUGEINT + y.c) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = array_to_string(gw[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.g = array_to_string(gw[k + 1:], ' ')
), low AS (SELECT lang, g, a, l, r, score FROM parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_places AS (SELECT lang, gw, a, m, s, unnest(range(1, m - s + 2)) AS p FROM cand, range(2, 4) t(s) WHERE m > s),
covers AS (SELECT lang, array_to_string(gw[p:p + s - 1], ' ') AS g, max(a) AS longer FROM inner_places GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN covers ON covers.lang = low.lang AND covers.g = low.g
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000
"""

_OP13 = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
enc AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc
), leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed, tampered
  FROM enc
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
), nd(tree, lvl, pos, h) AS (
  SELECT tree, 0, pos, leaf FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM nd) WHERE c > 1 GROUP BY tree, lvl, pos // 2
), heights AS (SELECT tree, max(lvl) AS top FROM nd GROUP BY tree),
sub AS (SELECT nd.tree, top, h AS subroot FROM nd JOIN heights ON heights.tree = nd.tree AND nd.lvl = top),
up(lvl, pos, h) AS (
  SELECT 0, tree, subroot FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM up) WHERE c > 1 GROUP BY lvl, pos // 2
), all_nodes AS (
  SELECT nd.tree, lvl, pos, h FROM nd JOIN heights ON heights.tree = nd.tree AND lvl < top
  UNION ALL SELECT sub.tree, top + lvl, pos, h FROM up, sub WHERE (sub.tree >> up.lvl) // 2 = pos // 2
), whole AS (SELECT max(lvl) AS high FROM up),
path(id, doc_id, tree, pos, top, lvl, proof, now) AS (
  SELECT row_number() OVER (), doc_id, placed.tree, pos, top, 0, '', CASE WHEN tampered THEN changed ELSE leaf END FROM placed JOIN sub ON sub.tree = placed.tree
  UNION ALL
  SELECT id, doc_id, path.tree, path.pos, top, path.lvl + 1, proof || coalesce(s.h, ''),
    CASE WHEN s.h IS NULL THEN sha256(now) WHEN (CASE WHEN path.lvl < top THEN path.pos >> path.lvl ELSE path.tree >> (path.lvl - top) END) % 2 = 0 THEN sha256(now || s.h) ELSE sha256(s.h || now) END
  FROM path JOIN whole ON path.lvl < top + high
  LEFT JOIN all_nodes s ON s.tree = path.tree AND s.lvl = path.lvl
    AND s.pos = xor(CASE WHEN path.lvl < top THEN path.pos >> path.lvl ELSE path.tree >> (path.lvl - top) END, 1)
)
SELECT p.doc_id, placed.leaf, sub.subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.now AS folded_root, p.now = r.h AS verified
FROM path p JOIN whole ON p.lvl = p.top + high JOIN sub ON sub.tree = p.tree JOIN up r ON r.lvl = high
JOIN placed ON placed.tree = p.tree AND placed.pos = p.pos
"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": _OP2,
    "op6_ngram_jaccard_join": _OP6,
    "op9_decontamination": _OP9,
    "op12_collocations": _OP12,
    "op13_merkle_manifest": _OP13,
}
