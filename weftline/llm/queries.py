"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, license_scan, line_dedup, packing, quality_cnn, quality_rules, simhash, url_filters, warc
from ._common import table

#: The tokenizer that documents are packed with.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Shares of the sources when packing: in proportion to their tokens to this power, so that
#: large ones give less to a window than the corpus has of them, and small ones more.
TEMPER = 0.7


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_filtered(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), TOKENIZER, targets=TEMPER)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id", 5, 0)))
    return language_id.with_language(docs.select("doc_id", "text", language_id.held_out("doc_id", 5, 0).alias("held_out")), model).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontamination.contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pages with a fetch time each, and a dated list of hosts and of their parent domains.

    The pages have neither, so both follow from page_id and from the host's MD5: of three
    hosts one is listed on a day of 2024, two thirds of these for 30 to 129 days only; of
    eight one's parent domain is listed for a week.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("timestamp_micros(1704067200000000 + ((page_id * 7919) % 525600) * 60000000)"))
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    n = F.conv(F.substring(F.md5(F.encode("host", "UTF-8")), 1, 7), 16, 10).cast("long")
    hosts = hosts.withColumn("n", n)
    day = "1704067200000000 + ({}) * 86400000000L"
    on = hosts.where("n % 3 = 0").select(F.col("host").alias("domain"), F.expr(f"timestamp_micros({day.format('n % 366')})").alias("at"), F.lit(True).alias("active"))
    off = hosts.where("n % 9 IN (0, 3)").select(F.col("host").alias("domain"), F.expr(f"timestamp_micros({day.format('n % 366 + 30 + n % 100')})").alias("at"), F.lit(False).alias("active"))
    parent = hosts.where("n % 8 = 0").withColumn("p", F.expr("regexp_replace(host, '^[^.]*[.]', '')")).where("p LIKE '%.%'")
    week = [parent.select(F.col("p").alias("domain"), F.expr(f"timestamp_micros({day.format(f'n % 366 + {d}')})").alias("at"), F.lit(on_).alias("active")) for d, on_ in ((0, True), (7, False))]
    return captures, on.unionByName(off).unionByName(week[0]).unionByName(week[1])


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = _captures(spark, sf_dir)
    return url_filters.listed(captures, entries).select("page_id", F.unix_seconds("fetched").alias("fetched_s"), "listed_by", F.col("listed_by").isNull().alias("kept"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = quality_cnn.fit(docs, labels.where(~language_id.held_out("doc_id", 3, 1)))
    return quality_cnn.with_quality(docs.select("doc_id", "text", language_id.held_out("doc_id", 3, 1).alias("held_out")), net).drop("text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a source is a tree with directories of 512 and of 64 ids, the first file of a small one its LICENSE."""
    name = F.expr("CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE concat('f', doc_id, '.txt') END")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.expr("concat('a', doc_id DIV 512)"), F.expr("CASE WHEN doc_id % 512 < 64 THEN NULL ELSE concat('b', doc_id % 512 DIV 64) END"), name).alias("path"), "text")
    return license_scan.scan(docs)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_quality_rules, op3_packing, op4_language_id, op5_decontamination, op6_url_filters, op7_quality_cnn, op8_line_dedup, op9_license_scan, op10_simhash)
}

_STOP = ", ".join(f"'{x}'" for x in license_scan.STOP)
_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.TEMPLATES))

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM t""",
    "op2_quality_rules": r"""
        WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
        c AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(x)) AS BIGINT) AS word_chars FROM p GROUP BY doc_id),
        g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(x, 2) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
        h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i AS j FROM r UNION ALL SELECT doc_id, i + 1 FROM r UNION ALL SELECT doc_id, i + 2 FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS ln FROM w),
        d AS (SELECT doc_id, count(*) - count(DISTINCT ln) AS n FROM l WHERE regexp_matches(ln, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        s AS (SELECT w.doc_id, w.source, CAST(coalesce(c.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(c.word_chars, 0) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words
              FROM w LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN h USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, n_words > 0 AND 10 * n_symbols > 3 * n_words AS f2,
                     n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS f3, n_dup_lines > 20 AS f4 FROM s),
        k AS (SELECT source, 1 AS rule, count(*) AS docs, count(*) FILTER (WHERE f1) AS fails FROM f WHERE source IS NOT NULL GROUP BY source
              UNION ALL SELECT source, 2, count(*), count(*) FILTER (WHERE f2) FROM f WHERE source IS NOT NULL GROUP BY source
              UNION ALL SELECT source, 3, count(*), count(*) FILTER (WHERE f3) FROM f WHERE source IS NOT NULL GROUP BY source
              UNION ALL SELECT source, 4, count(*), count(*) FILTER (WHERE f4) FROM f WHERE source IS NOT NULL GROUP BY source),
        m AS (SELECT rule, count(*) AS n, least(greatest(avg(CAST(fails AS DOUBLE) / docs), 1e-6), 1 - 1e-6) AS mean, var_samp(CAST(fails AS DOUBLE) / docs) AS v, avg(CAST(1 AS DOUBLE) / docs) AS inv FROM k GROUP BY rule),
        m2 AS (SELECT rule, mean, CASE WHEN n > 1 AND inv < 1 THEN (v / (mean * (1 - mean)) - inv) / (1 - inv) END AS own FROM m),
        m3 AS (SELECT rule, mean, CASE WHEN own > 0 THEN least(greatest(1 / own - 1, 1), 10000) ELSE 100 END AS strength FROM m2),
        bad AS (SELECT DISTINCT source FROM k JOIN m3 ON k.rule = m3.rule WHERE (fails + mean * strength) / (docs + strength) > 0.5)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed, NOT f1 AND bad.source IS NULL AS kept
        FROM f LEFT JOIN bad ON f.source = bad.source""",
    "op5_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
              FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(list_slice(ws, k, k + least(13, len(ws)) - 1), ' ') AS w
               FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS k FROM i WHERE len(ws) > 0)),
        ln AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS w
               FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d JOIN ln ON len(ws) >= n)),
        hit AS (SELECT dw.doc_id, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    "op6_url_filters": """
        WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)) AS host,
                          1704067200 + ((page_id * 7919) % 525600) * 60 AS fetched_s FROM pages),
        n AS (SELECT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS n FROM (SELECT DISTINCT host FROM h WHERE host <> '')),
        p AS (SELECT regexp_replace(host, '^[^.]*[.]', '') AS domain, n FROM n WHERE n % 8 = 0),
        e AS (SELECT host AS domain, n % 366 AS day, true AS active FROM n WHERE n % 3 = 0
              UNION ALL SELECT host, n % 366 + 30 + n % 100, false FROM n WHERE n % 9 IN (0, 3)
              UNION ALL SELECT domain, n % 366, true FROM p WHERE domain LIKE '%.%'
              UNION ALL SELECT domain, n % 366 + 7, false FROM p WHERE domain LIKE '%.%'),
        u AS (SELECT domain, day, bool_or(active) AS active FROM e GROUP BY domain, day),
        i AS (SELECT domain, active, 1704067200 + day * 86400 AS since, lead(1704067200 + day * 86400) OVER (PARTITION BY domain ORDER BY day) AS until FROM u),
        m AS (SELECT h.page_id, i.domain, row_number() OVER (PARTITION BY h.page_id ORDER BY length(i.domain) DESC) AS r
              FROM h JOIN i ON (h.host = i.domain OR h.host LIKE '%.' || i.domain)
              WHERE i.active AND h.fetched_s >= i.since AND (i.until IS NULL OR h.fetched_s < i.until))
        SELECT h.page_id, CAST(h.fetched_s AS BIGINT) AS fetched_s, m.domain AS listed_by, m.domain IS NULL AS kept
        FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.r = 1""",
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        g AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.*, g.keep IS NOT NULL AND g.keep <> k.doc_id AS dropped FROM k LEFT JOIN g ON k.key = g.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op9_license_scan": rf"""
        WITH f AS (SELECT doc_id, concat_ws('/', source, 'a' || (doc_id // 512), CASE WHEN doc_id % 512 < 64 THEN NULL ELSE 'b' || ((doc_id % 512) // 64) END,
                          CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE 'f' || doc_id || '.txt' END) AS path, text FROM documents),
        d AS (SELECT *, regexp_matches(path, '{license_scan.LICENCE_FILE}') AS is_file, regexp_replace(path, '/?[^/]*$', '') AS folder FROM f),
        bl AS (SELECT DISTINCT text, block FROM (SELECT text, unnest(regexp_split_to_array(text, '{license_scan.BETWEEN}')) AS block FROM d)),
        ln AS (SELECT text, block, string_split(block, chr(10)) AS ls FROM bl),
        rn AS (SELECT text, array_to_string(list_slice(ls, i, i + k - 1), chr(10)) AS unit FROM (SELECT text, ls, k, unnest(range(1, len(ls) - k + 2)) AS i FROM ln, (SELECT unnest(range(1, {license_scan.LINES} + 1)) AS k) WHERE len(ls) >= k)),
        s AS (SELECT text, 'header' AS via, unit FROM rn UNION SELECT text, 'header', block FROM bl UNION SELECT text, 'file', text FROM d WHERE is_file AND text IS NOT NULL),
        u AS (SELECT DISTINCT unit FROM s),
        tf AS (SELECT unit, term, 1 + ln(count(*)) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{license_scan.TERM}')) AS term FROM u) WHERE term NOT IN ({_STOP}) GROUP BY unit, term),
        t(i, licence, body) AS (VALUES {_TEMPLATES}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
        tt AS (SELECT i, term, 1 + ln(count(*)) AS w FROM (SELECT i, unnest(regexp_extract_all(lower(body), '{license_scan.TERM}')) AS term FROM t) WHERE term NOT IN ({_STOP}) GROUP BY i, term),
        idf AS (SELECT term, 1 + ln((1 + (SELECT n FROM n)) / (1 + count(*))) AS idf FROM tt GROUP BY term),
        tn AS (SELECT i, sqrt(sum(power(w * idf, 2))) AS norm FROM tt JOIN idf ON tt.term = idf.term GROUP BY i),
        un AS (SELECT unit, sqrt(sum(power(tf * coalesce(idf, 1 + ln(1 + (SELECT n FROM n))), 2))) AS norm FROM tf LEFT JOIN idf ON tf.term = idf.term GROUP BY unit),
        dot AS (SELECT unit, i, sum(tf * idf * w * idf) AS dot FROM tf JOIN idf ON tf.term = idf.term JOIN tt ON tf.term = tt.term GROUP BY unit, i),
        b AS (SELECT dot.unit, round(dot / (un.norm * tn.norm), 6) AS score, t.licence FROM dot JOIN un ON dot.unit = un.unit JOIN tn ON dot.i = tn.i JOIN t ON dot.i = t.i),
        b1 AS (SELECT unit, score, licence FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence DESC) AS r FROM b) WHERE r = 1 AND score >= 0.6),
        v AS (SELECT s.text, s.via, b1.score, b1.licence FROM s JOIN b1 ON s.unit = b1.unit),
        header AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, licence DESC) AS r FROM v WHERE via = 'header') WHERE r = 1),
        most AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, licence DESC, via DESC) AS r FROM v) WHERE r = 1),
        m AS (SELECT d.doc_id, d.path, d.folder, d.is_file, CASE WHEN is_file THEN most.licence ELSE header.licence END AS licence, CASE WHEN is_file THEN most.score ELSE header.score END AS score,
                     CASE WHEN is_file THEN most.via ELSE header.via END AS via FROM d LEFT JOIN most ON d.text = most.text LEFT JOIN header ON d.text = header.text),
        roots AS (SELECT folder AS root, licence, score, path FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, licence DESC, path DESC) AS r FROM m WHERE is_file AND licence IS NOT NULL) WHERE r = 1),
        near AS (SELECT m.doc_id, roots.*, row_number() OVER (PARTITION BY m.doc_id ORDER BY length(root) DESC) AS r FROM m JOIN roots ON m.folder = root OR starts_with(m.folder, root || '/') OR root = '' WHERE m.licence IS NULL)
        SELECT m.doc_id, m.path, coalesce(m.licence, near.licence) AS licence, coalesce(m.score, near.score) AS licence_score,
               CASE WHEN m.licence IS NOT NULL THEN m.via WHEN near.licence IS NOT NULL THEN 'inherited' END AS licence_via, CASE WHEN m.licence IS NOT NULL THEN m.path ELSE near.path END AS licence_from
        FROM m LEFT JOIN near ON m.doc_id = near.doc_id AND near.r = 1""",
}
