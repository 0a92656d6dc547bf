"""The registered queries of this package: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compression import compression_quality
from .decontamination import decontaminate
from .lexical_search import search
from .line_dedup import dedup_lines
from .lm_scoring import score_documents
from .minhash_dedup import near_duplicates
from .mixing import assign
from .periodic_runs import periodic_runs
from .secret_scan import listed, scan_secrets
from .substring_dedup import dedup_substrings
from .tables import id_text, table
from .token_counts import count_tokens
from .toxicity import toxicity
from .url_filter import filter_urls


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, range-sorted by the position of its first copy; untaken ones last."""
    first = F.col("copies")[0]["position"]
    return (assign(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"),
                    F.when(F.size("copies") > 0, first).alias("first_position"))
            .orderBy(F.col("first_position").asc_nulls_last(), "doc_id"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by crc32 of the id, the words from some place on repeat with a period."""
    h = F.crc32(id_text("doc_id").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.col("n").cast("long")
    period = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("long")
    place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1),
                        lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    repeated = F.array_join(F.transform(place, lambda i: F.get("words", i.cast("int"))), " ")
    # the words are only made where they are needed: the condition stands before them
    planted = (docs.select("doc_id", "text", h.alias("h"), g.cast("long").alias("g"))
               .withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
               .withColumn("a", F.when(F.col("n") > 0, F.col("g") % n)).withColumn("p", period))
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    strongest = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", strongest)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_token_counts, op2_url_filter, op3_lm_scoring, op4_decontamination, op5_quality_rules, op6_toxicity,
        op7_minhash_dedup, op8_substring_dedup, op9_mixing, op10_line_dedup, op11_secret_scan, op12_lexical_search,
        op13_periodic_runs)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"


def _url_sql() -> str:
    from .url_filter import SOFT, SOFT_LIMIT, STRICT

    def count(terms):
        listed = ", ".join(f"'{t}'" for t in terms)
        return (f"len(list_filter([{listed}], lambda t: regexp_matches(u, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))")

    # the four rules, spelled out; the longest that fits wins
    return f"""
WITH p AS (
  SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS u,
         {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    CAST({count(STRICT)} AS INTEGER) AS n_strict, CAST({count(SOFT)} AS INTEGER) AS n_soft
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft
FROM r"""


_DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT doc_id, item, i, n FROM grams JOIN win USING (n, g)),
words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '""" + _SPACE + r"""') AS w FROM documents),
grams AS (
  SELECT doc_id, i, hash(w[i:i + 12]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT g, min(doc_id) AS lo FROM grams GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place
  FROM grams JOIN first USING (g) WHERE lo < doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d)
  ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


_LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, line, place, list_distinct(regexp_extract_all(""" + _LOWER.format("line") + r""", '""" + _SPACE + r"""')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)),
c AS (
  SELECT list_sort(w) AS w, len(w) AS n, min((doc_id, place)) AS first FROM l WHERE len(w) > 0 GROUP BY list_sort(w), len(w)),
k AS (SELECT row_number() OVER (ORDER BY first) AS id, * FROM c),
t AS (SELECT id, n, unnest(w) AS word FROM k),
df AS (SELECT word, count(*) AS f FROM t GROUP BY word),
-- similar sets share one of the rarest words of either: the first n - ceil(0.8 n) + 1
p AS (
  SELECT id, n, word FROM (
    SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY f, word) AS r FROM t JOIN df USING (word))
  WHERE r <= n - CAST(ceil(n * 80 / 100) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.id AS early, b.id AS late FROM p a JOIN p b
  ON a.word = b.word AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
gone AS (
  SELECT DISTINCT late AS id FROM (
    SELECT late, x.n + y.n AS s, len(list_intersect(x.w, y.w)) AS o
    FROM pairs JOIN k x ON x.id = early JOIN k y ON y.id = late)
  WHERE 100 * o >= 80 * (s - o)),
decided AS (
  SELECT doc_id, place, line, len(l.w) > 0 AS filled,
         len(l.w) > 0 AND (gone.id IS NOT NULL OR (doc_id, place) <> k.first) AS removed
  FROM l LEFT JOIN k ON k.w = list_sort(l.w) LEFT JOIN gone ON gone.id = k.id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (removed) AS n_removed,
         string_agg(line, chr(10) ORDER BY place) FILTER (NOT removed) AS kept
  FROM decided GROUP BY doc_id) USING (doc_id)"""


_SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT item_id, unnest(list_distinct(
    regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, total GROUP BY term, docs),
hit AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part
  FROM tf JOIN weight USING (term), total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN hit USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50"""


# crc32 of the id bit by bit: a list of the bytes, each followed by eight steps (-1)
_RUNS_SQL = r"""
WITH c AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '""" + _SPACE + r"""') AS w, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      string_split(CAST(coalesce(doc_id, 0) AS VARCHAR), ''),
      lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)) AS h
  FROM documents),
p AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a,
         1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p
  FROM c),
x AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
-- pairs of equal words q apart, in unbroken rows of at least 3 q
pair AS (
  SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r
  ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
island AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair)
  GROUP BY doc_id, q, k HAVING count(*) >= greatest(6 - q, 3 * q)),
-- a longer period of the same stretch is no smallest one
run AS (SELECT doc_id, s, length, min(q) AS q FROM island GROUP BY doc_id, s, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS runs
  FROM run GROUP BY doc_id),
best AS (
  SELECT * FROM run a WHERE NOT EXISTS (
    SELECT 1 FROM run b WHERE a.doc_id = b.doc_id AND (b.length * a.q > a.length * b.q
      OR (b.length * a.q = a.length * b.q AND (b.s, b.q) < (a.s, a.q)))))
SELECT p.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
       CAST(q AS BIGINT) AS period, CAST(1000 * length // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM p LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express; the tests hold the others against plain Python."""
    return {"op2_url_filter": _url_sql(), "op4_decontamination": _DECONTAMINATION_SQL,
            "op8_substring_dedup": _SUBSTRING_SQL, "op10_line_dedup": _LINE_SQL,
            "op12_lexical_search": _SEARCH_SQL, "op13_periodic_runs": _RUNS_SQL}
