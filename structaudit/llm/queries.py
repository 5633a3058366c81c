"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structaudit.llm import bpe, decontam, embed, langid, pii, repair, repeats, secrets, shard, simhash, spelling, toxic, twins, warc
from structaudit.llm.common import table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one."""
    return decontam.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text keeps once all repeated strings of 200 bytes are gone."""
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits among captures of all pages, each with its base and merged headers."""
    found = warc.resolved(warc.captures_of(table(spark, sf_dir, "pages")))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    return found.select("revisit_id", "url", "base_id", "status", fields.alias("headers"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``rows``."""
    return shard.feistel_shards(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [pii.kind_count(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone", "iban", "national")]
    return found.select(
        "doc_id", *counts[:4], pii.digest(pii.span_list(F.col("spans"), base_only=True)).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
        *counts[4:],
    )


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the vocabulary of words and word ends."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), word_vocabulary())


def op7_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return embed.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: three words, three bits."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in all documents, judged by the forest."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their near words, forms and roots."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels that are not held out."""
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and the cheapest edits that mend it."""
    return repair.repaired_after_damage(table(spark, sf_dir, "conversations"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_decontamination, op2_bwt_repeats, op3_warc_revisits, op4_feistel_shards, op5_trie_bpe, op6_pii, op7_projections,
        op8_simhash, op9_language, op10_secrets, op11_spelling, op12_toxicity, op13_conversation_repair,
    )
}

#: The revisits by a plain join: every earlier response of the URL, then the latest.
WARC_SQL = r"""
with page as (select page_id, url, 1600000000 + page_id * 7919 % 31536000 as began, concat('"', md5(coalesce(html, '')), '"') as etag, octet_length(encode(html)) as size from pages),
dated as (select *, strftime(make_timestamp(began * 1000000), '%Y-%m-%d %H:%M:%S') as modified from page),
raw as (
  select page_id * 3 as id, 'response' as kind, url, began as captured, etag, modified, 'max-age=60' as cache, null as expires, size from dated
  union all
  select page_id * 3 + 1, 'revisit', regexp_replace(url, '^https://', 'HTTPS://'), began + 40000,
         case page_id % 4 when 0 then '"stale"' when 1 then concat('W/', etag) end, case when page_id % 4 = 2 then modified end, 'max-age=120', null, null from dated
  union all
  select page_id * 3 + 2, 'revisit', url || '#part', began - 3600, etag, null, null, '0', null from dated),
bare as (select * replace (regexp_replace(trim(url), '#.*$', '') as url) from raw),
cut as (select *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) as host,
               regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') as rest from bare),
kept as (select *, case scheme when 'http' then regexp_replace(host, ':80$', '') when 'https' then regexp_replace(host, ':443$', '') else host end as site,
                coalesce(nullif(regexp_replace(rest, '\?.*$', ''), ''), '/') as path,
                array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)'))), '&') as query from cut),
rec as (select id, kind, case when site = '' then url else concat(scheme, '://', site, path, case when query = '' then '' else '?' || query end) end as url, captured, etag, modified, cache, expires, size from kept),
met as (select v.id as revisit_id, v.url, r.id as base_id, v.etag, v.modified, v.cache, v.expires, r.etag as old_etag, r.modified as old_modified, r.cache as old_cache, r.size
        from rec v left join rec r on r.kind = 'response' and r.url = v.url and r.captured < v.captured where v.kind = 'revisit'
        qualify row_number() over (partition by v.id order by r.captured desc nulls last, r.id desc) = 1),
judged as (select *, case when base_id is null then 'no_base' when etag is null and modified is null then 'unchecked'
                          when etag is not null then case when regexp_replace(etag, '^W/', '') = old_etag then 'resolved' else 'mismatch' end
                          when modified = old_modified then 'resolved' else 'mismatch' end as status from met)
select revisit_id, url, base_id, status, case when status in ('resolved', 'unchecked') then array_to_string(list_sort(list_filter([
  'cache-control: ' || coalesce(cache, old_cache), 'content-length: ' || size, 'content-type: text/html', 'etag: ' || coalesce(etag, old_etag),
  'expires: ' || expires, 'last-modified: ' || coalesce(modified, old_modified)], lambda x: x is not null)), chr(10)) end as headers
from judged"""

#: Fingerprints, alignments, models and tokens have no SQL; tests hold those queries against brute force.
SQL: dict[str, str] = {
    "op3_warc_revisits": WARC_SQL, "op4_feistel_shards": twins.SHARD_SQL, "op6_pii": twins.PII_SQL, "op11_spelling": twins.SPELLING_SQL,
    "op13_conversation_repair": twins.REPAIR_SQL,
}
