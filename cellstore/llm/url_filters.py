"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every URL is expanded into pairs of a host suffix and a path prefix. A rule has one such pair; both sides carry the
SHA-256 digest of the pair and its first bytes. The join is on those short prefixes; full digests are compared
afterwards, and of the rules that fit a URL the one of highest precedence decides. Only built-in functions run.

Which suffixes and prefixes are worth expanding follows from the rules: as many labels as the longest rule host has,
and the lengths of the rules' paths. So a URL gives at most labels x lengths expressions, however long it is.

Defined cases: a null URL, or one without "://", has an empty host and path; no rule fits it and the default verdict
holds. Repeated rows stay, each with its verdict. Rules that are alike but disagree: block wins. Without rules every URL
gets the default. An empty table gives an empty result. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, lower_ascii, with_column_free

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def digest(host: Column, path: Column) -> Column:
    """Of the pair; "\\n" can't be told from the host otherwise, so the host's length comes first."""
    return F.sha2(F.concat_ws("\n", F.length(host).cast("string"), host, path).cast("binary"), 256)


def url_filter(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """One row for each row of pages: id, host, path, rule (host + path) and verdict. rules: host, path, action."""
    with_column_free(pages, id_column, url_column)
    rules = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isin("allow", "block"))
    rules = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action"))
    shape = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path")), F.count("*")).first()
    labels, lengths, n_rules = shape[0] or 0, sorted(shape[1]), shape[2]

    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).alias("_url"))
    rows = rows.groupBy("_id", "_url").agg(F.count("*").alias("_copies"))
    host, path = split_url(F.coalesce(F.col("_url"), F.lit("")))
    rows = rows.withColumns({"host": host, "path": path})
    if n_rules:
        suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
        prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
        pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
        asked = rows.withColumn("_pair", F.explode_outer(pairs)).withColumn("_digest", digest(F.col("_pair.h"), F.col("_pair.p"))).drop("_pair")
        asked = asked.withColumn("_short", F.substring("_digest", 1, 2 * prefix_bytes))
        known = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("_short", F.substring("r_digest", 1, 2 * prefix_bytes))
        if n_rules <= BROADCAST_ROWS:
            known = F.broadcast(known)
        found = asked.join(known, "_short", "left")
        confirmed = F.when(F.col("r_digest") == F.col("_digest"), F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_action").alias("action"), F.concat("r_host", "r_path").alias("rule")))
        rows = found.groupBy("_id", "_url", "_copies", "host", "path").agg(F.max(confirmed).alias("_best"))
        rule, action = F.col("_best.rule"), F.col("_best.action")
    else:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    rows = rows.select(F.col("_id").alias(id_column), "host", "path", rule.alias("rule"), F.coalesce(action, F.lit(default)).alias("verdict"), "_copies")
    return rows.withColumn("_k", F.explode(F.expr("sequence(1L, _copies)"))).drop("_k", "_copies")


ORACLE = """
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
d AS (SELECT c.*, (SELECT rh || rp FROM r WHERE (c.host = rh OR ends_with(c.host, '.' || rh)) AND starts_with(c.path, rp) ORDER BY length(rh) + length(rp) DESC LIMIT 1) AS rule FROM c)
SELECT page_id, host, path, rule, coalesce((SELECT action FROM r WHERE rh || rp = d.rule), 'allow') AS verdict FROM d
"""
