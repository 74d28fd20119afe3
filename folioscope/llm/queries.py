"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    collocations,
    decontaminate,
    edit_embedding,
    exact_dedup,
    licenses,
    mixing,
    near_dedup,
    quality,
    ranked_search,
    secrets,
    sharding,
    suffix_dedup,
    warc_store,
)

#: Domains that labels define, with the share of tokens that each is to have in the mixture.
DOMAINS = {"clean": 0.9, "low": 0.07, "toxic": 0.03}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, domain) of the labelled documents; rows without a quality label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("low")
    known = labels.where("quality is not null").select("doc_id", domain.alias("domain"))
    return docs.select("doc_id", "text").join(known, "doc_id")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = mixing.mixture(docs, domain_labels(docs, table(spark, sf_dir, "labels")), DOMAINS)
    shares = [F.element_at("posterior", k + 1).alias(f"p_{name}") for k, name in enumerate(DOMAINS)]
    return rated.select(F.col("rid").alias("doc_id"), "n_tokens", *shares, "rate", mixing.copies(F.col("rate"), F.col("rid")).alias("n_copies"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.size("hit_words").cast("long")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), percent=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, least = secrets.fit_secrets(docs)
    found = secrets.scan_secrets(docs.select("doc_id", "text"), model, least_ratio=least)
    base = F.filter("spans", lambda s: s["kind"] != "markov")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", sharding.text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    learn = docs.where(fold != 0).select("doc_id", "text")
    positives = learn.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    unlabelled = learn.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    model, _ = quality.fit_quality(positives, unlabelled)
    scored = quality.score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    own = F.transform("detections", lambda d: d["label"])
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", own)))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edit_fingerprints(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_decontaminate, op3_near_dedup, op4_exact_dedup, op5_scan_secrets, op6_shard, op7_quality, op8_warc_store, op9_suffix_dedup, op10_scan_licenses,
        op11_edit_fingerprints, op12_ranked_search, op13_collocations,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: SQL for the operators that it can express in full.
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
with items as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
windows as (select distinct item, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
            from items, unnest(range(1, len(w) - least(10, len(w)) + 2)) u(i) where len(w) > 0),
docs as (select doc_id, {_WORDS} as w from documents),
looks as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as s from docs, (select distinct k from windows) z, unnest(range(1, len(w) - k + 2)) u(i)),
hits as (select doc_id, i, looks.k as k, item from looks join windows using (k, s)),
covered as (select doc_id, count(distinct p) as n from hits, unnest(range(i, i + k)) q(p) group by doc_id),
found as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(covered.n, 0)::bigint as n_hit, coalesce(found.n, 0)::bigint as n_items,
       sha256(coalesce(found.s, '')) as items_sha256, covered.n is not null as contaminated
from docs left join covered using (doc_id) left join found using (doc_id)""",
    "op12_ranked_search": f"""
with docs as (select doc_id, {_WORDS} as w from documents),
n as (select count(*) filter (len(w) > 0)::bigint as n_docs, sum(len(w))::bigint as n_terms from docs),
items as (select distinct item_id, unnest({_WORDS}) as t from benchmark),
tf as (select doc_id, len(w)::bigint as n, t, count(*)::bigint as tf from (select doc_id, w, unnest(w) as t from docs) where t in (select t from items) group by all),
df as (select t, count(*) as df from tf group by t),
weight as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as weight from df, n),
scored as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n.n_docs * tf.n) // n.n_terms))))::bigint as score
           from items join tf using (t) join weight using (t), n group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50""",
    "op13_collocations": f"""
with lists as (select coalesce(lang, 'und') as lang, unnest(list_transform(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]'), lambda x: regexp_extract_all(x, '[^\\x20\\x09]+'))) as w from documents),
n as (select lang, sum(len(w))::bigint as n from lists group by lang),
pieces as (select lang, w, row_number() over () as piece from lists),
each as (select lang, piece, unnest(w) as w1, generate_subscripts(w, 1) as i from pieces),
runs as (select lang, w1, lead(w1, 1) over z as w2, lead(w1, 2) over z as w3, lead(w1, 3) over z as w4 from each window z as (partition by piece order by i)),
phrases as (select lang, 1 as words, w1 as phrase from runs
            union all select lang, 2, concat_ws(' ', w1, w2) from runs where w2 is not null
            union all select lang, 3, concat_ws(' ', w1, w2, w3) from runs where w3 is not null
            union all select lang, 4, concat_ws(' ', w1, w2, w3, w4) from runs where w4 is not null),
f as (select lang, words, phrase, count(*)::bigint as f from phrases group by all having count(*) >= 30),
c as (select *, string_split(phrase, ' ') as w from f where words > 1),
cuts as (select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, ((2000000::hugeint * c.f) // (l.f + r.f))::bigint as score
         from c, unnest(range(1, c.words)) u(k), f l, f r
         where l.lang = c.lang and l.phrase = array_to_string(c.w[:k], ' ') and r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(f) as longer from c, unnest([2, 3]) q(m), unnest(range(1, c.words - m + 2)) u(i) where m < c.words group by all),
kept as (select best.* from best left join inner_ using (lang, phrase) where longer is null or 100 * longer < 80 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000""",
    "op4_exact_dedup": f"""
with n as (select doc_id, {_LOWER} as t from documents), g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)""",
}
