"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language_id, line_dedup, lm_score, minhash_dedup, source_mix, suffix_dedup, url_filter, warc
from ._shared import table

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.report(table(spark, sf_dir, "documents"))


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every taking of op1_source_mix, in the order of training."""
    return source_mix.training_order(source_mix.takings(source_mix.mix(table(spark, sf_dir, "documents"))))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: rows of good quality that aren't toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lm_score.score(docs, lm_score.train(docs, labels.where("quality = 1 and coalesce(toxic, 0) = 0")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip(table(spark, sf_dir, "documents")).drop("kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


URL_ORACLE = """
with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, len(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from u),
r(verdict, h, q) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m as (select page_id, arg_max(h || q, len(h || q)) rule, arg_max(verdict, len(h || q)) verdict from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by 1)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') verdict from p left join m on p.page_id = m.page_id
"""

QUERIES = {f.__name__: f for f in (op1_source_mix, op1_training_order, op2_url_filter, op3_warc, op4_lm_score, op5_minhash, op6_decontaminate, op7_suffix_dedup, op8_line_dedup, op9_embedding_dedup, op10_language_id)}

WARC_ORACLE = """
with p as (select page_id, coalesce(html, '') h from pages),
f as (select h, min(page_id) first from p where octet_length(encode(h)) >= 100 group by h)
select page_id, cast(octet_length(encode(p.h)) as bigint) payload_bytes, sha256(p.h) payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end record_type,
  case when first is not null and page_id is distinct from first then first end refers_to
from p left join f on p.h = f.h
"""

ORACLES = {
    "op3_warc": WARC_ORACLE,
    "op1_source_mix": source_mix.ORACLE.format(documents="documents"),
    "op2_url_filter": URL_ORACLE,
    "op6_decontaminate": decontaminate.ORACLE.format(documents="documents"),
    "op8_line_dedup": line_dedup.ORACLE.format(documents="documents"),
}
