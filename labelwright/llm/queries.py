"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binslack, decontaminate, divergence, jaccard_join, langid, license_scan, linedup, packing, pii, quality, quotes, trie, warc
from .common import scratch_path, table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    base = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), base)
    return warc.read(spark, base, with_payload=False).drop("url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary()).drop("group_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one for tests; production callers pass their own secret."""
    found = pii.pseudonymise_documents(table(spark, sf_dir, "documents"), "key for tests", ["doc_id"])
    return found.select("doc_id", F.size("spans").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"), F.col("clean_text").alias("text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = langid.identify(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_total", "line_removed", "wholly_spread", "text")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binslack.pack_documents(table(spark, sf_dir, "documents"), byte_vocabulary())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc,
        op2_quality_rules,
        op3_license_scan,
        op4_packing,
        op5_jaccard_join,
        op6_pseudonyms,
        op7_language_id,
        op8_quote_linking,
        op9_line_dedup,
        op10_benchmark_decontamination,
        op11_bin_slack,
        op12_prefix_trie,
        op13_source_divergence,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_quality_rules": OP2, "op9_line_dedup": OP9, "op12_prefix_trie": OP12, "op13_source_divergence": OP13}


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(0, greatest(len(ws) - 4, 0))) AS i, ws FROM w),
k AS (SELECT rid, i, ws[i + 1 : i + 5] AS gram FROM g),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM k),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum((base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.3 * n_lines)::INT) AS f FROM b GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS mu, var_pop(f / n) AS v FROM h),
q AS (SELECT mu, CASE WHEN v > 0 THEN least(10000.0, greatest(1.0, mu * (1 - mu) / v - 1)) ELSE 10000.0 END AS s FROM p),
x AS (SELECT source, (f + mu * s) / (n + s) > 0.5 AS host_rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
       NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l),
s AS (SELECT line FROM w WHERE n > 0 GROUP BY line HAVING count(DISTINCT source) >= 10),
f AS (SELECT w.*, s.line IS NOT NULL AS spread FROM w LEFT JOIN s ON w.line = s.line),
a AS (SELECT rid, sum((n > 0)::INT) AS line_total, sum(spread::INT) AS hit, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT spread) AS rest FROM f GROUP BY rid)
SELECT doc_id, coalesce(line_total, 0)::BIGINT AS line_total, coalesce(hit, 0)::BIGINT AS line_removed,
       coalesce(hit > 0 AND hit = line_total, false) AS wholly_spread,
       CASE WHEN hit > 0 THEN coalesce(rest, '') ELSE text END AS text
FROM d LEFT JOIN a USING (rid)
"""

# The table of CRC-32 follows from its polynomial; conversation ids are short texts, folded a byte at a time.
OP12 = r"""
WITH RECURSIVE bit AS (
    SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT b, v FROM bit WHERE k = 8),
raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM raw),
crc AS (
    SELECT conv_id, s, 1 AS i, 4294967295::BIGINT AS c FROM ids
    UNION ALL SELECT conv_id, s, i + 1, xor(c // 256, tab.v) FROM crc JOIN tab ON tab.b = xor(c & 255, ascii(s[i])::BIGINT) WHERE i <= length(s)),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(c, 4294967295) % 9 AS h FROM crc WHERE i > length(s)),
given AS (SELECT h.conv_id, r.pos, r.role, r.text FROM h JOIN raw r ON r.conv_id = h.base AND r.pos <= h.h),
n AS (SELECT h.conv_id, h.h, count(g.pos) AS n FROM h LEFT JOIN given g USING (conv_id) GROUP BY ALL),
turns AS (SELECT conv_id, pos AS d, role, text FROM given UNION ALL SELECT r.conv_id, r.pos - n.h + n.n, r.role, r.text FROM raw r JOIN n USING (conv_id) WHERE r.pos > n.h),
ranked AS (SELECT conv_id, d, sha256(length(role) || ':' || role || text) AS t, strlen(text) AS size FROM turns),
walk AS (
    SELECT conv_id, 0::BIGINT AS d, '' AS p, 0::BIGINT AS size FROM h
    UNION ALL SELECT w.conv_id, r.d, sha256(w.p || r.t), r.size FROM walk w JOIN ranked r ON r.conv_id = w.conv_id AND r.d = w.d + 1),
len AS (SELECT conv_id, max(d) AS len FROM walk GROUP BY conv_id),
node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM walk GROUP BY d, p),
par AS (SELECT c.d, c.p, any_value(q.p) AS pp FROM walk c JOIN walk q ON q.conv_id = c.conv_id AND q.d = c.d - 1 GROUP BY c.d, c.p),
kids AS (SELECT d - 1 AS d, pp AS p, count(*) AS n FROM par GROUP BY ALL),
leaf AS (SELECT node.*, kids.n IS NULL AS childless FROM node LEFT JOIN kids USING (d, p)),
up AS (SELECT DISTINCT w.d, w.p, b.d AS bd, b.p AS bp FROM walk w JOIN walk b ON b.conv_id = w.conv_id AND b.d >= w.d),
below AS (SELECT up.d, up.p, sum(l.saved) AS saved_tokens, sum(l.childless::INT) AS n_leaves FROM up JOIN leaf l ON l.d = up.bd AND l.p = up.bp GROUP BY ALL),
fin AS (SELECT w.d, w.p, string_agg(w.conv_id::VARCHAR, ',' ORDER BY w.conv_id) AS ends FROM walk w JOIN len ON len.conv_id = w.conv_id AND len.len = w.d GROUP BY ALL)
SELECT node.conv_id, node.d AS depth, up1.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(fin.ends, '')) AS ends_sha256
FROM node JOIN below USING (d, p) LEFT JOIN par USING (d, p) LEFT JOIN node up1 ON up1.d = par.d - 1 AND up1.p = par.pp
LEFT JOIN kids USING (d, p) LEFT JOIN fin USING (d, p)
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT rid) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS whole FROM c GROUP BY ALL HAVING sum(df) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, k.whole, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS n FROM f GROUP BY ALL),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 5)) // (s.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (f.whole + 5)) // (v.n + 5 * v.v) AS q
      FROM f JOIN s USING (lang, source) JOIN v ON v.lang = f.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
