"""Inputs of the operators, derived from the driver's tables.

Each binding exists twice: as a DataFrame here and as a SQL common table
expression in `CTE`, built from the same columns by the same arithmetic.  No
binding drops rows to stay small; what is absent from a pass or a layer is
absent because another table says so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from treegauge.functions.content import sha256_hex
from treegauge.operators.blockindex import Index, write as write_index
from treegauge.operators.content import classify
from treegauge.operators.scope import rule_mode

# The moments of the two catalogue passes.
PASS_1 = "1998-06-30"
PASS_2 = "1999-06-30"

SCOPE = [("/home", "include"), ("/home/low", "exclude"), ("/home/low/c1", "include"),
         ("/home/high/c9", "exclude"), ("/home/urgent", "include")]

# A limit that some documents exceed, for the two queries about reasons; other layers take the library's own.
MAX_BYTES = 16384

ROOT_IGNORES = "# generated\n*.txt\n!1*.txt\nde/\nsrc1/en/*7.md\nsrc2/**\n"
SOURCE_IGNORES = "!2*.txt\n/fr/*3.MD\nes/\n!en/*.txt\n"

CTE = {
    "docfiles": """docfiles AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         l.quality AS quality, l.toxic AS toxic,
         '/home/' || d.source || '/' || d.lang || '/' || d.doc_id ||
         CASE WHEN l.quality IS NULL THEN '.md' WHEN l.quality = 1 THEN '.MD' ELSE '.txt' END
           AS path,
         'file' AS kind, d.n_chars AS size, d.n_chars * 1000 AS mtime_ns
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "catalogue": """catalogue AS (
  SELECT path, kind, size FROM docfiles
  UNION ALL SELECT DISTINCT '/home/' || source || '/' || lang, 'dir', CAST(4096 AS BIGINT)
            FROM documents
  UNION ALL SELECT DISTINCT '/home/' || source, 'dir', CAST(4096 AS BIGINT) FROM documents
  UNION ALL SELECT DISTINCT '/home/' || source || '/.git', 'dir', CAST(4096 AS BIGINT)
            FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)
                             AND lang = 'de')""",
    "content": """content AS (
  SELECT path, doc_id, size, mtime_ns, text, sha256(text) AS sha256 FROM docfiles)""",
    "raw": """raw AS (
  SELECT path, mtime_ns,
         CASE WHEN quality = 0 AND toxic = 0 THEN encode(text) || '\\x00'::BLOB || encode(text)
              WHEN quality = 0 AND toxic = 1 THEN NULL
              WHEN toxic = 1 THEN encode('-----BEGIN PGP MESSAGE-----' || text)
              WHEN lang = 'fr' THEN encode(text) || '\\x96'::BLOB
              ELSE encode(text) END AS bytes, size
  FROM docfiles)""",
    "layer": """layer AS (
  SELECT path, size, mtime_ns, reason,
         CASE WHEN reason IS NULL THEN decode(bytes) END AS text,
         CASE WHEN reason IS NULL THEN sha256(bytes) END AS sha256
  FROM (SELECT *, CASE
      WHEN size > 1048576 THEN 'too_large'
      WHEN bytes IS NULL THEN 'unreadable'
      WHEN substr(hex(bytes), 1, 54) = hex(encode('-----BEGIN PGP MESSAGE-----')) THEN 'encrypted'
      WHEN regexp_matches(substr(hex(bytes), 1, 16384), '^([0-9A-F]{2})*?00') THEN 'binary'
      WHEN TRY(decode(bytes)) IS NULL THEN 'undecodable' END AS reason FROM raw))""",
    "capped": """capped AS (
  SELECT path, size, mtime_ns, reason,
         CASE WHEN reason IS NULL THEN decode(bytes) END AS text,
         CASE WHEN reason IS NULL THEN sha256(bytes) END AS sha256
  FROM (SELECT *, CASE
      WHEN size > 16384 THEN 'too_large'
      WHEN bytes IS NULL THEN 'unreadable'
      WHEN substr(hex(bytes), 1, 54) = hex(encode('-----BEGIN PGP MESSAGE-----')) THEN 'encrypted'
      WHEN regexp_matches(substr(hex(bytes), 1, 16384), '^([0-9A-F]{2})*?00') THEN 'binary'
      WHEN TRY(decode(bytes)) IS NULL THEN 'undecodable' END AS reason FROM raw))""",
    "now_files": """now_files AS (
  SELECT path, 'file' AS kind,
         mtime_ns + CASE WHEN doc_id IN (SELECT conv_id FROM conversations) THEN 1 ELSE 0 END
           AS mtime_ns
  FROM docfiles WHERE doc_id NOT IN (SELECT item_id FROM benchmark))""",
    "vectors": """vectors AS (
  SELECT c.sha256, CAST(e.vec_id - 2 * (e.vec_id // 2) AS INTEGER) AS ord, e.embedding AS vector
  FROM embeddings e JOIN content c ON c.doc_id = e.vec_id // 2)""",
    "passes": """passes AS (
  SELECT l_orderkey AS k,
         CAST(sum(CASE WHEN l_shipdate <= DATE '1998-06-30' THEN l_quantity END) AS BIGINT) AS size_1,
         CAST(sum(CASE WHEN l_shipdate <= DATE '1999-06-30' THEN l_quantity END) AS BIGINT) AS size_2,
         epoch_us(max(CASE WHEN l_shipdate <= DATE '1998-06-30' THEN l_shipdate END)) * 1000 AS m_1,
         epoch_us(max(CASE WHEN l_shipdate <= DATE '1999-06-30' THEN l_shipdate END)) * 1000 AS m_2,
         max(CASE WHEN l_shipdate <= DATE '1998-06-30' THEN l_returnflag || l_linestatus END) AS h_1,
         max(CASE WHEN l_shipdate <= DATE '1999-06-30' THEN l_returnflag || l_linestatus END) AS h_2,
         coalesce(bool_or(l_returnflag = 'R' AND l_discount >= 0.09
                          AND l_shipdate <= DATE '1998-06-30'), false) AS gone_1,
         coalesce(bool_or(l_returnflag = 'R' AND l_discount >= 0.09
                          AND l_shipdate <= DATE '1999-06-30'), false) AS gone_2
  FROM lineitem GROUP BY l_orderkey),
orderfiles AS (
  SELECT *, '/home/' || replace(lower(substr(o_orderpriority, 3)), ' ', '_') || '/c' || o_custkey
            || '/' || o_orderkey || '.md' AS path,
         CASE WHEN o_totalprice < 5000 THEN 'link' ELSE 'file' END AS kind
  FROM orders JOIN passes ON o_orderkey = k),
scoped AS (
  SELECT *, NOT (starts_with(path, '/home/low/') AND NOT starts_with(path, '/home/low/c1/'))
            AND NOT starts_with(path, '/home/high/c9/') AS in_scope FROM orderfiles),
old_pass AS (
  SELECT path, kind, in_scope, size_1 AS size, m_1 AS mtime_ns,
         CASE WHEN o_orderstatus <> 'P' THEN sha256(h_1) END AS content_hash,
         CASE o_orderstatus WHEN 'O' THEN 'backfilled' WHEN 'F' THEN 'compared' END AS hash_source,
         CASE WHEN o_totalprice <= 450000 THEN sha256(h_1) END AS digest
  FROM scoped WHERE m_1 IS NOT NULL AND NOT gone_1),
new_pass AS (
  SELECT path, kind, in_scope, size_2 AS size, m_2 AS mtime_ns,
         CASE WHEN o_totalprice <= 450000 THEN sha256(h_2) END AS hash_now
  FROM scoped WHERE m_2 IS NOT NULL AND NOT gone_2)""",
    "journal": """journal AS (
  SELECT coalesce(o.path, n.path) AS path, n.kind, n.in_scope, CASE
      WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
      WHEN o.size = n.size AND o.mtime_ns = n.mtime_ns THEN 'unchanged'
      WHEN NOT (n.kind = 'file' AND n.in_scope) OR n.hash_now IS NULL
           OR o.content_hash IS NULL THEN 'unconfirmed'
      WHEN n.hash_now = o.content_hash THEN 'touched' ELSE 'changed' END AS state,
    o.content_hash AS old_hash, o.hash_source AS old_source,
    CASE WHEN n.kind = 'file' AND n.in_scope THEN n.hash_now END AS h
  FROM old_pass o FULL JOIN new_pass n ON o.path = n.path)""",
    "linked": """linked AS (
  SELECT path, sha256(text) AS sha256, text FROM (
    SELECT path, text || ' see [[' || (doc_id // 2) || ']] and [x](../en/' || (doc_id // 3)
      || '.md) or [r](' || source || '/en/' || (doc_id // 5) || '.md#top) ![i](p.png) '
      || '[e](https://x.org/' || lang || ') [[' || (doc_id // 7) || '.md|other]]' AS text
    FROM docfiles
    UNION ALL SELECT '/home/labels/' || doc_id || '.md', 'quality ' || quality || ' toxic ' || toxic
    FROM labels
    UNION ALL SELECT '/home/conv/' || conv_id || '/' || turn || '.md',
      text || ' [[' || turn || ']]' FROM conversations))""",
    "links": """wiki AS (
  SELECT path, sha256, true AS is_wiki, unnest(regexp_extract_all(text,
           '\\[\\[([^\\]|#]+)(?:\\|[^\\]]*)?\\]\\]', 1)) AS raw,
         generate_subscripts(regexp_extract_all(text,
           '\\[\\[([^\\]|#]+)(?:\\|[^\\]]*)?\\]\\]', 1), 1) - 1 AS pos FROM linked),
inline AS (
  SELECT path, sha256, false AS is_wiki, unnest(regexp_extract_all(text,
           '(?:^|[^!])\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1)) AS raw,
         generate_subscripts(regexp_extract_all(text,
           '(?:^|[^!])\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1), 1) - 1 AS pos FROM linked),
links AS (SELECT * FROM wiki UNION ALL SELECT * FROM inline),
targets AS (
  SELECT *, regexp_replace(path, '[^/]*$', '') AS here,
         regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', '') AS base_stem,
         regexp_extract(path, '\\.[^./]*$') AS suffix,
         split_part(raw, '#', 1) AS cleaned,
         NOT regexp_matches(raw, '^(https?://|mailto:)') AS local FROM links),
names AS (
  SELECT DISTINCT regexp_extract(path, '[^/]+$') AS name, regexp_extract(path, '\\.[^./]*$') AS suffix,
         sha256 FROM linked
  UNION SELECT DISTINCT regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', ''),
         regexp_extract(path, '\\.[^./]*$'), sha256 FROM linked),
per_name AS (SELECT name, count(*) AS n, min(sha256) AS sha FROM names GROUP BY name),
per_suffix AS (SELECT name, suffix, count(*) AS n, min(sha256) AS sha FROM names GROUP BY name, suffix),
resolved AS (
  SELECT t.path, t.sha256 AS src, t.raw, t.is_wiki, t.pos,
    coalesce(a.sha256, b.sha256) AS exact, p.n AS candidates,
    CASE WHEN p.n = 1 THEN p.sha END AS only_sha, CASE WHEN s.n = 1 THEN s.sha END AS same_sha
  FROM targets t
  LEFT JOIN linked a ON t.local AND t.cleaned <> '' AND a.path =
    regexp_replace(t.here || t.cleaned, '/[^/]+/\\.\\./', '/')
  LEFT JOIN linked b ON t.local AND t.cleaned <> '' AND b.path =
    regexp_replace('/home/' || t.cleaned, '/[^/]+/\\.\\./', '/')
  LEFT JOIN per_name p ON t.is_wiki AND p.name = t.raw
  LEFT JOIN per_suffix s ON t.is_wiki AND s.name = t.raw AND s.suffix = t.suffix),
outcomes AS (
  SELECT path, src, raw, is_wiki, pos,
    CASE WHEN exact IS NOT NULL THEN exact WHEN is_wiki THEN coalesce(only_sha, same_sha) END AS dst,
    CASE WHEN exact IS NOT NULL THEN CASE WHEN is_wiki THEN 'md_wikilink_path' ELSE 'md_inline' END
         WHEN NOT is_wiki THEN NULL WHEN only_sha IS NOT NULL THEN 'md_wikilink_unique'
         WHEN same_sha IS NOT NULL THEN 'md_wikilink_same_ext' END AS method,
    CASE WHEN exact IS NOT NULL THEN 1.0::DOUBLE
         WHEN is_wiki AND coalesce(only_sha, same_sha) IS NOT NULL THEN 0.9::DOUBLE END AS confidence,
    CASE WHEN exact IS NOT NULL THEN 'stated'
         WHEN is_wiki AND coalesce(only_sha, same_sha) IS NOT NULL THEN 'derived'
         WHEN is_wiki AND candidates IS NOT NULL THEN 'ambiguous' ELSE 'outside' END AS outcome
  FROM resolved),
edges AS (
  SELECT src, dst, 'link' AS kind, method, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst
      ORDER BY confidence DESC, path, NOT is_wiki, pos) AS rn
    FROM outcomes WHERE dst IS NOT NULL) WHERE rn = 1)""",
    "coded": """coded AS (
  SELECT path, text || ' ' || source || 'Lang' || upper(lang) || 'Size' || n_chars || ' '
         || CASE WHEN quality IS NULL THEN 'plainText' WHEN quality = 1 THEN 'HTTPLabel.goodText'
                 ELSE 'HTTPLabel.bad_text' END AS text
  FROM docfiles)""",
    "symbols": """words AS (
  SELECT path, w FROM (SELECT path, unnest(list_distinct(
    regexp_extract_all(text, '[0-9A-Za-z_.\\-/]+'))) AS w FROM coded)),
parts AS (
  SELECT path, list_filter(string_split(lower(trim(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(w, '[^0-9A-Za-z]+', ' ', 'g'),
      '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'),
      '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'),
      ' +', ' ', 'g'))), ' '), lambda x: x <> '') AS p FROM words),
symbols AS (
  SELECT path, list_sort(list_distinct(flatten(list(p)))) AS s FROM parts
  WHERE len(p) > 1 GROUP BY path),
tokens AS (
  SELECT c.path, 'text' AS col, generate_subscripts(tt, 1) AS pos, unnest(tt) AS term
  FROM (SELECT path, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS tt
        FROM coded) c
  UNION ALL SELECT path, 'symbols', generate_subscripts(s, 1), unnest(s) FROM symbols),
dl AS (SELECT path, count(*) AS dl FROM tokens GROUP BY path),
corpus AS (SELECT (SELECT count(*) FROM coded) AS n, (SELECT sum(dl) FROM dl) * 1.0::DOUBLE
                  / (SELECT count(*) FROM coded) AS avgdl)""",
    "treefiles": """treefiles AS (
  SELECT '/home/o' || l_orderkey AS dir, '/home/o' || l_orderkey || '/' || l_linenumber || '.dat'
         AS path, l_orderkey AS k, l_linenumber AS line,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size
  FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "prints": """lines AS (
  SELECT d.dir, d.size, sha256(substr(d.path, length(d.dir) + 2) || chr(0) || d.size) AS h FROM (
    SELECT dir, path, size FROM treefiles UNION ALL SELECT '/home', path, size FROM treefiles) d),
prints AS (
  SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, sha256(concat_ws(':', count(*),
    bit_xor(('0x' || substr(h, 1, 15))::BIGINT), bit_xor(('0x' || substr(h, 16, 15))::BIGINT)))
    AS fingerprint FROM lines GROUP BY dir)""",
    "watched": """watched AS (
  SELECT event_id, ts, event_type, value, CASE
    WHEN event_type = 'signup' THEN '/home/u' || user_id || '/.gitignore'
    WHEN event_type = 'click' AND value < 5 THEN '/home/u' || user_id || '/store/index.db-wal'
    ELSE '/home/u' || user_id || '/' || event_type || '/' || event_id || '.log' END AS path,
    user_id FROM events),
stores AS (
  SELECT DISTINCT '/home/u' || user_id || '/store' AS folder FROM events),
projects AS (
  SELECT DISTINCT 'u' || user_id AS project_id, '/home/u' || user_id AS path FROM events
  UNION ALL SELECT DISTINCT 'e' || user_id, '/home/u' || user_id || '/error' FROM events
  WHERE event_type = 'error' AND value > 20),
owned AS (
  SELECT w.*, coalesce(e.project_id, p.project_id) AS project_id FROM watched w
  LEFT JOIN projects e ON e.path = '/home/u' || w.user_id || '/error'
                       AND w.event_type = 'error'
  LEFT JOIN projects p ON p.path = '/home/u' || w.user_id)""",
    "snaps": """snaps AS (
  SELECT o_custkey AS project_id, o_orderkey AS snapshot_id, o_orderdate AS taken_at,
         c_mktsegment <> 'BUILDING' AS living,
         (SELECT max(o_orderdate) FROM orders) AS now
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
}


def with_ctes(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"


#: Where each session has written the index of a folder's documents.
_INDEXES: dict[tuple[str, str], str] = {}


class Inputs:
    """The same bindings as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet("%s/%s.parquet" % (self.folder, name))

    def docfiles(self) -> DataFrame:
        d, l = self.table("documents"), self.table("labels")
        ext = (F.when(F.col("quality").isNull(), ".md").when(F.col("quality") == 1, ".MD")
               .otherwise(".txt"))
        return d.join(l, "doc_id", "left").select(
            "*", F.concat(F.lit("/home/"), "source", F.lit("/"), "lang", F.lit("/"),
                          F.col("doc_id").cast("string"), ext).alias("path"),
            F.lit("file").alias("kind"), F.col("n_chars").alias("size"),
            (F.col("n_chars") * 1000).alias("mtime_ns"))

    def catalogue(self) -> DataFrame:
        d = self.table("documents")

        def dirs(df: DataFrame, path) -> DataFrame:
            return df.select(path.alias("path"), F.lit("dir").alias("kind"),
                             F.lit(4096).cast("bigint").alias("size")).distinct()

        source = F.concat(F.lit("/home/"), "source")
        git = d.filter(F.col("lang") == "de").join(
            self.table("benchmark").select(F.col("item_id").alias("doc_id")),
            "doc_id", "left_semi")
        return (self.docfiles().select("path", "kind", "size")
                .unionByName(dirs(d, F.concat(source, F.lit("/"), "lang")))
                .unionByName(dirs(d, source))
                .unionByName(dirs(git, F.concat(source, F.lit("/.git")))))

    def content(self) -> DataFrame:
        return self.docfiles().select(
            "path", "doc_id", "size", "mtime_ns", "text",
            sha256_hex(F.col("text").cast("binary")).alias("sha256"),
            F.lit(None).cast("string").alias("reason"))

    def raw(self) -> DataFrame:
        text = F.col("text").cast("binary")

        def of(raw: bytes):
            return F.lit(bytearray(raw))

        return self.docfiles().select(
            "path", "size", "mtime_ns",
            F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.concat(text, of(b"\0"), text))
            .when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit(None))
            .when(F.col("toxic") == 1, F.concat(of(b"-----BEGIN PGP MESSAGE-----"), text))
            .when(F.col("lang") == "fr", F.concat(text, of(b"\x96")))
            .otherwise(text).alias("bytes"))

    def layer(self) -> DataFrame:
        return classify(self.raw())

    def capped(self) -> DataFrame:
        return classify(self.raw(), MAX_BYTES)

    def now_files(self) -> DataFrame:
        edited = self.table("conversations").select(
            F.col("conv_id").alias("doc_id")).distinct().withColumn("edited", F.lit(1))
        gone = self.table("benchmark").select(F.col("item_id").alias("doc_id"))
        return (self.docfiles().select("doc_id", "path", "kind", "mtime_ns")
                .join(gone, "doc_id", "left_anti").join(edited, "doc_id", "left")
                .select("path", "kind", (F.col("mtime_ns") + F.coalesce("edited", F.lit(0)))
                        .alias("mtime_ns")))

    def vectors(self) -> DataFrame:
        e = self.table("embeddings").select(
            F.expr("vec_id div 2").alias("doc_id"),
            F.expr("cast(vec_id - 2 * (vec_id div 2) as int)").alias("ord"),
            F.col("embedding").alias("vector"))
        return e.join(self.content().select("doc_id", "sha256"), "doc_id").select(
            "sha256", "ord", "vector")

    def orderfiles(self) -> DataFrame:
        def upto(day: str, value):
            return F.when(F.col("l_shipdate") <= F.lit(day).cast("timestamp_ntz"), value)

        gone = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
        aggs = []
        for i, day in ((1, PASS_1), (2, PASS_2)):
            aggs += [
                F.sum(upto(day, F.col("l_quantity"))).cast("bigint").alias("size_%d" % i),
                (F.unix_micros(F.max(upto(day, F.col("l_shipdate"))).cast("timestamp")) * 1000)
                .alias("m_%d" % i),
                F.max(upto(day, F.concat("l_returnflag", "l_linestatus"))).alias("h_%d" % i),
                F.coalesce(F.bool_or(upto(day, gone)), F.lit(False)).alias("gone_%d" % i)]
        versions = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*aggs)
        priority = F.replace(F.lower(F.substring("o_orderpriority", 3, 99)), F.lit(" "), F.lit("_"))
        return (self.table("orders").join(versions, "o_orderkey")
                .withColumn("path", F.concat(
                    F.lit("/home/"), priority, F.lit("/c"), F.col("o_custkey").cast("string"),
                    F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".md")))
                .withColumn("kind", F.when(F.col("o_totalprice") < 5000, "link").otherwise("file"))
                .withColumn("in_scope", F.coalesce(rule_mode("path", SCOPE) == "include",
                                                   F.lit(False))))

    def _pass(self, i: int) -> DataFrame:
        return self.orderfiles().filter(
            F.col("m_%d" % i).isNotNull() & ~F.col("gone_%d" % i)).withColumn(
            "digest", F.when(F.col("o_totalprice") <= 450000,
                             F.sha2(F.col("h_%d" % i), 256)))

    def old_pass(self) -> DataFrame:
        return self._pass(1).select(
            "path", "kind", "in_scope", F.col("size_1").alias("size"), F.col("m_1").alias("mtime_ns"),
            F.when(F.col("o_orderstatus") != "P", F.sha2("h_1", 256)).alias("content_hash"),
            F.when(F.col("o_orderstatus") == "O", "backfilled")
            .when(F.col("o_orderstatus") == "F", "compared").alias("hash_source"), "digest")

    def new_pass(self) -> DataFrame:
        return self._pass(2).select(
            "path", "kind", "in_scope", F.col("size_2").alias("size"), F.col("m_2").alias("mtime_ns"),
            F.col("digest").alias("hash_now"))

    def linked(self) -> DataFrame:
        def s(text):
            return F.lit(text)

        def over(n):
            return F.expr("cast(doc_id div %d as string)" % n)

        docs = self.docfiles().select("path", F.concat(
            "text", s(" see [["), over(2), s("]] and [x](../en/"), over(3), s(".md) or [r]("),
            "source", s("/en/"), over(5), s(".md#top) ![i](p.png) [e](https://x.org/"), "lang",
            s(") [["), over(7), s(".md|other]]")).alias("text"))
        labels = self.table("labels").select(
            F.concat(s("/home/labels/"), "doc_id", s(".md")).alias("path"),
            F.concat(s("quality "), "quality", s(" toxic "), "toxic").alias("text"))
        turns = self.table("conversations").select(
            F.concat(s("/home/conv/"), "conv_id", s("/"), "turn", s(".md")).alias("path"),
            F.concat("text", s(" [["), "turn", s("]]")).alias("text"))
        return docs.unionByName(labels).unionByName(turns).select(
            "path", F.sha2("text", 256).alias("sha256"), "text")

    def coded(self) -> DataFrame:
        mark = (F.when(F.col("quality").isNull(), "plainText")
                .when(F.col("quality") == 1, "HTTPLabel.goodText").otherwise("HTTPLabel.bad_text"))
        return self.docfiles().select("path", F.concat(
            "text", F.lit(" "), "source", F.lit("Lang"), F.upper("lang"), F.lit("Size"),
            F.col("n_chars").cast("string"), F.lit(" "), mark).alias("text"))

    def index(self) -> Index:
        """The stored index of `coded`, written once per session and folder."""
        context = self.spark.sparkContext
        key = (context.applicationId, self.folder)
        if key not in _INDEXES:
            shared = context.getCheckpointDir() or self.spark.conf.get("spark.checkpoint.dir")
            folder = "%s/index-%s" % (shared.rstrip("/"), uuid.uuid4().hex)
            write_index(self.coded(), folder)
            _INDEXES[key] = folder
        return Index(self.spark, _INDEXES[key])

    def treefiles(self) -> DataFrame:
        return (self.table("lineitem").groupBy("l_orderkey", "l_linenumber")
                .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("size"))
                .select(F.concat(F.lit("/home/o"), "l_orderkey").alias("dir"),
                        F.concat(F.lit("/home/o"), "l_orderkey", F.lit("/"), "l_linenumber",
                                 F.lit(".dat")).alias("path"),
                        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"),
                        F.lit("file").alias("kind"), "size"))

    def watched(self) -> DataFrame:
        user = F.concat(F.lit("/home/u"), F.col("user_id").cast("string"))
        path = (F.when(F.col("event_type") == "signup", F.concat(user, F.lit("/.gitignore")))
                .when((F.col("event_type") == "click") & (F.col("value") < 5),
                      F.concat(user, F.lit("/store/index.db-wal")))
                .otherwise(F.concat(user, F.lit("/"), "event_type", F.lit("/"),
                                    F.col("event_id").cast("string"), F.lit(".log"))))
        return self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
            path.alias("path"), "user_id")

    def stores(self) -> DataFrame:
        return self.table("events").select(F.concat(
            F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/store/index.db")).alias("path")).distinct()

    def projects(self) -> DataFrame:
        e = self.table("events")
        user = F.col("user_id").cast("string")
        return (e.select(F.concat(F.lit("u"), user).alias("project_id"),
                         F.concat(F.lit("/home/u"), user).alias("path")).distinct()
                .unionByName(e.filter((F.col("event_type") == "error") & (F.col("value") > 20))
                             .select(F.concat(F.lit("e"), user).alias("project_id"),
                                     F.concat(F.lit("/home/u"), user, F.lit("/error"))
                                     .alias("path")).distinct()))

    def snaps(self) -> DataFrame:
        return (self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("snapshot_id"),
                    F.col("o_orderdate").cast("timestamp").alias("taken_at"),
                    (F.col("c_mktsegment") != "BUILDING").alias("living")))

    def snaps_now(self):
        return self.table("orders").agg(F.max("o_orderdate").cast("timestamp")).scalar()

    def ignores(self) -> DataFrame:
        sources = self.table("documents").select("source").distinct()
        return sources.select(
            F.explode(F.array(
                F.struct(F.lit("/home").alias("base"), F.lit(ROOT_IGNORES).alias("text")),
                F.struct(F.concat(F.lit("/home/"), "source").alias("base"),
                         F.lit(SOURCE_IGNORES).alias("text")))).alias("f")
        ).select("f.base", "f.text").distinct()
