"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, conversation_trie, decontamination, i_match, jaccard_join, language_id, packing, quality_classifier, quality_rules, spelling, token_counts, token_files, warc
from .common import bound_batches, fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_read(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_dir(spark)
    warc.write_archives(_read(spark, sf_dir, "pages"), out)
    return warc.read_archives(spark, out, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"), size=3, percent=90)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_dir(spark, "tokens")
    token_files.write_files(_read(spark, sf_dir, "documents"), out)
    return token_files.read_files(spark, out, with_ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    out = language_id.identify(documents, documents.where(fold("doc_id", 4) != 2))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    out = quality_classifier.classify(documents, documents.where(fold("doc_id", 5) != 0), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.profile(token_counts.histogram(_read(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i_match.fingerprints(_read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_read(spark, sf_dir, "conversations"))


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS b, sha1(h) AS d FROM p),
g AS (SELECT d, max(page_id) AS m FROM q WHERE b >= 1000 GROUP BY d)
SELECT q.page_id, q.b AS payload_bytes, q.d AS payload_digest,
       CASE WHEN g.m IS NOT NULL AND (q.page_id IS NULL OR q.page_id < g.m) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.m IS NOT NULL AND (q.page_id IS NULL OR q.page_id < g.m) THEN g.m END AS refers_to
FROM q LEFT JOIN g ON q.d = g.d AND q.b >= 1000
"""


OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: concat(t[i], ' ', t[i + 1], ' ', t[i + 2]))) END) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS n_equal FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b, ka.rep <> kb.rep AS other, kb.rep FROM p JOIN k ka ON ka.doc_id = p.a JOIN k kb ON kb.doc_id = p.b WHERE 100 * c >= 90 * (ka.n + kb.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
l AS (SELECT a, count(DISTINCT rep) AS n_links FROM e WHERE other GROUP BY 1),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, c.component_id, CASE WHEN k.n = 0 THEN 0 ELSE k.n_equal END AS n_equal, coalesce(l.n_links, 0) AS n_links
FROM k JOIN c ON c.id = k.doc_id LEFT JOIN l ON l.a = k.doc_id
"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes; column t of table crc has the polynomial's table."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])))"


_CRC = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


OP11 = rf"""
WITH RECURSIVE {_CRC},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT d, run, count(*) AS n, length(run) AS l FROM r WHERE length(run) >= 5 GROUP BY 1, 2),
h AS (SELECT run, n, l, {_crc32("concat(d, ':', run)")} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % l), substr(run, h % l + 2)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS l FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
x AS (SELECT word, n, l, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS cut FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM v)),
e AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.cut = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.cut = v.word),
m AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS best, max(v.n) AS best_n FROM e JOIN v ON v.word = e.b GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
p AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL),
o AS (SELECT p.word, p.root FROM p JOIN f ON f.word = p.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(o.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN o ON o.word = f.word
"""


OP13 = rf"""
WITH {_CRC},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, md5(concat(strlen(role), ':', role, text)) AS k, len(list_filter(regexp_split_to_array(text, '[ 	-]+'), lambda x: x <> '')) AS w FROM t),
p AS (SELECT conv_id, k, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS i FROM d),
c AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - ((conv_id % 20) + 20) % 20 AS other FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, p.i, p.k, p.w FROM c JOIN p ON p.conv_id = c.conv_id AND p.i >= c.h UNION ALL SELECT c.conv_id, p.i, p.k, p.w FROM c JOIN p ON p.conv_id = c.other AND p.i < c.h),
s AS (SELECT c.conv_id, coalesce(list(r.k ORDER BY r.i) FILTER (WHERE r.k IS NOT NULL), []) AS ks, coalesce(list(r.w ORDER BY r.i) FILTER (WHERE r.k IS NOT NULL), []) AS ws FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY 1),
e AS (SELECT conv_id, len(ks) AS l, ks, ws, unnest(range(0, len(ks) + 1)) AS depth FROM s),
n AS (SELECT depth, array_to_string(ks[1:depth], '') AS id, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE ws[depth] END) AS w,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = depth), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
k AS (SELECT a.depth, a.id, count(b.id) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND starts_with(b.id, a.id) GROUP BY 1, 2),
u AS (SELECT a.id, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.w) AS BIGINT) AS saved_tokens FROM n a JOIN n b ON starts_with(b.id, a.id) JOIN k ON k.id = b.id GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN k ON k.id = n.id JOIN u ON u.id = n.id LEFT JOIN n q ON q.depth = n.depth - 1 AND starts_with(n.id, q.id)
"""


def queries() -> dict:
    return {f.__name__: f for n, f in globals().items() if n.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op3_jaccard_join": OP3, "op11_spelling": OP11, "op13_conversation_trie": OP13}
