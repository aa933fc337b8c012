"""The queries that apply the operators of this subpackage to whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import ann, decontaminate, line_dedup, minhash, packing, quality, token_counts, token_store, url_filter, warc
from strandloom.llm.common import fresh_path

#: (action, host, path) of op7.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, with_payload=False).where("gap_reason is null")
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, those removed because an equal or a similar one stays elsewhere, and the MD5 of what stays."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), reach=line_dedup.REACH)
    return kept.select("doc_id", "n_lines", "n_exact", "n_fuzzy", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_store.read_tokens(spark, path)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the least id of its class of near-duplicates, and whether it stands for the class."""
    classes = minhash.document_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stands"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_packing, op4_token_counts, op5_warc, op6_line_dedup, op7_url_filter, op8_ann, op9_token_store, op10_minhash)}

#: Words of a text as op2 takes them.
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
        with d as (select row_number() over () as r, doc_id, {_WORDS.format("text")} as w from documents),
        b as (select cast(item_id as varchar) as item, {_WORDS.format("text")} as w from benchmark),
        win as (select distinct item, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as s
                from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
        spots as (select r, k.n, i, array_to_string(w[i : i + k.n - 1], ' ') as s
               from d, (select distinct n from win) k, unnest(range(1, len(w) - k.n + 2)) as t(i) where len(w) >= k.n),
        hit as (select r, n, i, item from spots join win using (n, s)),
        hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, n, i from hit)) group by r),
        items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hit group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hits using (r) left join items using (r)""",
    "op7_url_filter": r"""
        with u as (select page_id,
                     coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as r from pages),
        rules(action, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fit as (select r, max(struct_pack(size := length(h) + length(p), hs := length(h), rule := h || p, action := action)) as best
                from u join rules on (host = h or host like '%.' || h) and starts_with(path, p) group by r)
        select page_id, host, path, best.rule as rule, coalesce(best.action, 'allow') as verdict from u left join fit using (r)""",
}
