"""The registered queries over the test tables: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogue, licenses, media, near_dedup, phrases, pii, piece_codec, quality, repeats, token_counts, toxicity, url_filter
from .common import held_out, table

#: Context length that op3 asks about, and least score that op6 calls toxic.
TOKEN_LIMIT, TOXIC = 2048, 0.7


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.NAMES))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    more = F.transform("risky", lambda s: F.struct(s["start"], s["kind"], s["end"]))

    def count(kind: int):
        # a second parameter of a lambda, default or not, would be the element's index
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    spans = F.array_sort(F.concat("base", more))
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(spans).alias("spans"), F.size(spans).cast("long").alias("n_found"))


def op3_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT, with_table=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col("fits").alias("fits_chars"))


def op4_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_media(table(spark, sf_dir, "documents"), with_media=False)
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("feature_bits")).alias("feature"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.fit_tagger(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, tagger)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("section", F.concat_ws("/", "source", "lang"))
    return quality.score_quality(docs, table(spark, sf_dir, "labels"), host="source", path="section")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("removed"), F.lower(F.hex("kept")).alias("kept_hex"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_report(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "aliased")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_prefix_tokens, op4_png_media, op5_minhash_near_dedup, op6_toxicity, op7_quality, op8_repeats, op9_sentencepiece, op10_licenses, op11_conversation_repair, op12_phrases, op13_url_filter)}

#: Near-duplicate components and repeated windows say themselves in SQL; the others rest on models, libraries' vocabularies or file formats.
ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END)) AS i FROM words),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    linked AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
    reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN ways l ON l.a = reach.id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.r AS component_id, d.doc_id = c.r AS kept FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) c ON c.id = d.doc_id""",
    "op8_repeats": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), s AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
    again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1), r AS (SELECT doc_id, i FROM s SEMI JOIN again USING (h)), g AS (SELECT doc_id, i, sum(CASE WHEN i - was <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM r)),
    cut AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run), kept AS (SELECT doc_id, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM cut UNION ALL SELECT doc_id, max(z), NULL FROM cut GROUP BY doc_id),
    txt AS (SELECT d.doc_id, b, coalesce(string_agg(substr(hex(b), 2 * a - 1, 2 * (coalesce(z, octet_length(b) + 1) - a)), '' ORDER BY a), hex(any_value(b))) AS x FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id, b),
    n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM cut GROUP BY doc_id)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256, coalesce(n_removed, 0) > 0 AS removed, lower(x) AS kept_hex FROM txt LEFT JOIN n USING (doc_id)""",
    "op11_conversation_repair": r"""WITH RECURSIVE tab AS (
        SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
    hashed AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM raw, tab),
    hurt AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM hurt),
    told AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM placed),
    sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND was || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM told GROUP BY conv_id),
    go(conv_id, i, z, s, u, a) AS (
        SELECT conv_id, n, {'c': 0, 'e': ''}, {'c': 10, 'e': 'II'}, {'c': 5, 'e': 'I'}, {'c': 0, 'e': ''} FROM sums
        UNION ALL
        SELECT conv_id, i, list_sort([dz, {'c': du.c + 5, 'e': 'I' || du.e}, {'c': da.c + 10, 'e': 'II' || da.e}])[1], list_sort([ds, {'c': du.c + 5, 'e': 'I' || du.e}, {'c': da.c + 10, 'e': 'II' || da.e}])[1],
            list_sort([du, {'c': da.c + 5, 'e': 'I' || da.e}])[1], list_sort([da, {'c': du.c + 5, 'e': 'I' || du.e}])[1]
        FROM (SELECT conv_id, i,
            list_sort([{'c': z.c + 2, 'e': 'D' || z.e}, {'c': u.c + gone + cut + 1, 'e': 'R' || u.e}, CASE r WHEN 's' THEN {'c': s.c + gone + cut, 'e': 'K' || s.e} WHEN 'u' THEN {'c': u.c + gone + cut, 'e': 'K' || u.e} ELSE {'c': 1000000, 'e': ''} END])[1] AS dz,
            list_sort([{'c': s.c + 2, 'e': 'D' || s.e}, {'c': u.c + gone + cut + 1, 'e': 'R' || u.e}, CASE r WHEN 'u' THEN {'c': u.c + gone + cut, 'e': 'K' || u.e} ELSE {'c': 1000000, 'e': ''} END])[1] AS ds,
            list_sort([{'c': u.c + 2, 'e': 'D' || u.e}, {'c': a.c + gone + cut + 1, 'e': 'R' || a.e}, CASE r WHEN 'a' THEN {'c': a.c + gone + cut, 'e': 'K' || a.e} ELSE {'c': 1000000, 'e': ''} END])[1] AS du,
            list_sort([{'c': a.c + 2, 'e': 'D' || a.e}, {'c': u.c + gone + cut + 1, 'e': 'R' || u.e}, CASE r WHEN 'u' THEN {'c': u.c + gone + cut, 'e': 'K' || u.e} ELSE {'c': 1000000, 'e': ''} END])[1] AS da
            FROM (SELECT g.conv_id, g.i - 1 AS i, z, s, u, a, r, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM go g JOIN told t ON t.conv_id = g.conv_id AND t.i = g.i))),
    best AS (SELECT conv_id, z.c AS cost, z.e AS audit FROM go WHERE i = 0),
    walk(conv_id, j, i, q, audit, role, text) AS (
        SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', audit, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM best
        UNION ALL
        SELECT w.conv_id, j + 1, CASE op WHEN 'I' THEN w.i ELSE w.i + 1 END, CASE WHEN op = 'D' THEN q WHEN op = 'K' THEN t.r WHEN q = 'u' THEN 'a' ELSE 'u' END, audit,
            CASE WHEN op = 'D' THEN NULL WHEN op = 'K' THEN t.role WHEN q = 'u' THEN 'assistant' ELSE 'user' END, CASE op WHEN 'D' THEN NULL WHEN 'I' THEN '' ELSE t.text END
        FROM (SELECT *, substr(audit, j + 1, 1) AS op FROM walk WHERE j < length(audit)) w LEFT JOIN told t ON t.conv_id = w.conv_id AND t.i = w.i + 1),
    fixed AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY j) AS body FROM walk WHERE role IS NOT NULL GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN fixed USING (conv_id)""",
    "op12_phrases": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces), sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
    places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, range(1, 6) t(k) WHERE len(w) >= k),
    grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
    wanted AS (SELECT * FROM grams x WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM grams y WHERE y.lang = x.lang AND y.k > x.k AND y.f >= x.f AND contains(' ' || y.g || ' ', ' ' || x.g || ' '))),
    parts AS (SELECT lang, g, f AS a, c, array_to_string(string_split(g, ' ')[1:c], ' ') AS head, array_to_string(string_split(g, ' ')[c + 1:k], ' ') AS tail FROM wanted, range(1, 5) t(c) WHERE c < k),
    scored AS (SELECT p.lang, p.g AS phrase, a, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score, c FROM parts p JOIN grams x ON x.lang = p.lang AND x.g = p.head JOIN grams y ON y.lang = p.lang AND y.g = p.tail JOIN sizes s ON s.lang = p.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000""",
    "op13_url_filter": r"""WITH RECURSIVE p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query, coalesce(html, '') AS html FROM pages),
    rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    tags AS (SELECT page_id, host, path, host || CASE path WHEN '' THEN '/' ELSE path END || query AS node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE host <> ''),
    raw AS (SELECT *, CASE WHEN regexp_matches(tag, '(?is)^<link.*[\s"''/]rel\s*=\s*["'']?([^"''>]*\s)?canonical([\s"''>])') THEN regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)
        WHEN regexp_matches(tag, '(?is)^<meta.*[\s"''/]http-equiv\s*=\s*["'']?refresh[\s"''>]') THEN regexp_extract(regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '(?is)^["'']?[\s\d.]*[;,]\s*url\s*=\s*(.*)$', 1) END AS link FROM tags),
    links AS (SELECT node, host, path, regexp_replace(replace(trim(regexp_replace(trim(link), '^["'']+|["'']+$', '', 'g')), '&amp;', '&'), '(?s)#.*$', '') AS l FROM raw WHERE link IS NOT NULL AND link <> ''),
    full_ AS (SELECT node, CASE WHEN regexp_matches(l, '(?i)^https?://') THEN l WHEN starts_with(l, '//') THEN 'http:' || l WHEN l = '' OR regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(l, '/') THEN 'http://' || host || l WHEN starts_with(l, '?') THEN 'http://' || host || path || l
        ELSE 'http://' || host || CASE regexp_extract(path, '(?s)^(.*/)', 1) WHEN '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || l END AS t FROM links),
    ends AS (SELECT node, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(t, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS query FROM full_ WHERE t IS NOT NULL),
    edges AS (SELECT node AS a, host || CASE path WHEN '' THEN '/' ELSE path END || query AS b FROM ends),
    places AS (SELECT DISTINCT host, path FROM p UNION SELECT host, path FROM ends),
    judged AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM places JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
    reach AS (SELECT a AS id, a AS r FROM edges UNION SELECT b, b FROM edges UNION SELECT e.b, reach.r FROM reach JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON e.a = reach.id),
    said AS (SELECT host || CASE path WHEN '' THEN '/' ELSE path END || query AS node, verdict FROM (SELECT host, path, query FROM p UNION SELECT host, path, query FROM ends) JOIN judged USING (host, path)),
    class AS (SELECT reach.id, bool_or(verdict = 'allow') AS ok, bool_or(verdict = 'block') AS bad FROM reach JOIN said ON said.node = reach.r GROUP BY reach.id)
    SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN ok THEN 'allow' WHEN bad THEN 'block' END, 'allow') AS verdict, rule IS NULL AND coalesce(ok OR bad, false) AS aliased
    FROM p LEFT JOIN judged USING (host, path) LEFT JOIN class ON class.id = p.host || CASE p.path WHEN '' THEN '/' ELSE p.path END || p.query AND p.host <> ''""",
}
