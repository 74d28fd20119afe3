"""Queries over a log of merge decisions, and over word pairs and plurals, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import lexicon
from folioscope.operators import merge_log, pairs, search
from folioscope.plans import queries as plain

Query = Callable[[SparkSession, str], DataFrame]

#: A user's decisions: a chain, one of its links taken back from the middle, and a decision made anew.
LOG = [
    (1, "merge", "des", "que", None), (2, "merge", "que", "und", None), (3, "separate", "the", "que", None), (4, "merge", "über", "und", None),
    (5, "undo", None, None, 1), (6, "merge", "und", "the", None), (7, "merge", "nowhere", "the", None), (8, "merge", "über", "tion", None), (9, "merge", "tion", "des", None),
]
SOURCE = "small ring"


def log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOG, merge_log.SCHEMA)


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """(word, count) of all cloud words of the documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(search.CLOUD_WORD), F.lit(0))
    return plain.pages(spark, sf).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = pairs.collocated(plain.pages(spark, sf))
    return found.select("a", "b", "n", "n_a", "n_b", F.floor(F.col("score") * 1000).alias("score_1000"))


QUERIES: dict[str, Query] = {
    "merge_log_state": lambda s, d: merge_log.state(plain.hits(s, d), log(s)).select("term", "page_idx", "page_label"),
    "merge_log_earlier_state": lambda s, d: merge_log.state(plain.hits(s, d), log(s), 4).select("term", "page_idx", "page_label"),
    "merge_log_changes": lambda s, d: merge_log.changes(plain.hits(s, d), log(s), 4, 5).select("term", "page_idx", "change"),
    "merge_candidates": lambda s, d: merge_log.candidates(plain.word_occ(s, d), SOURCE).select("target", "pages", "common", "rank"),
    "cloud_collocations": pair_scores,
    "cloud_plurals": lambda s, d: pairs.folded_plurals(counts(s, d)).select("word", "count", "forms"),
    "cloud_with_pairs": lambda s, d: pairs.cloud_with_pairs(plain.pages(s, d)),
}


def _state(version: int) -> str:
    """The log replayed: each source goes to its target, and on by later merges of that."""
    rows = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in LOG)
    return f"""
with recursive log(version, action, source, target, undoes) as (values {rows}),
known as (select * from log where version <= {version}),
left_over as (select * from known where action <> 'undo' and version not in (select undoes from known where action = 'undo')),
chosen as (select * from left_over qualify row_number() over (partition by source order by version desc) = 1),
occ as ({plain._hits_sql()}),
merges as (select version, source, target from chosen where action = 'merge' and source in (select term from occ) and target in (select term from occ)),
chase(source, term, version, first) as (
  select source, target, version, version from merges
  union all select c.source, m.target, m.version, c.first from chase c join merges m on m.source = c.term and m.version > c.version),
final as (select source, arg_max(term, version) as term, min(first) as first from chase group by source),
state as (select coalesce(final.term, occ.term) as term, page_idx, arg_min(page_label, coalesce(final.first, 0)) as page_label
          from occ left join final on final.source = occ.term group by 1, 2)"""


_STOP = ", ".join(f"'{w}'" for w in sorted(lexicon.CLOUD_STOPWORDS))
_PAIRS = rf"""
lists as (select doc_id, regexp_extract_all(lower(text), '\p{{L}}[\p{{L}}\p{{N}}_'']+') as w from documents),
each as (select doc_id, unnest(w) as a, generate_subscripts(w, 1) as i from lists),
beside as (select a, lead(a) over (partition by doc_id order by i) as b from each),
pairs as (select a, b, count(*) as n from beside where b is not null and a not in ({_STOP}) and b not in ({_STOP}) group by a, b),
total as (select sum(n)::double as t from pairs), firsts as (select a, sum(n)::bigint as n_a from pairs group by a), seconds as (select b, sum(n)::bigint as n_b from pairs group by b),
cells as (select a, b, n, n_a, n_b, t, [n, n_a - n, n_b - n, t - n_a - n_b + n] as o,
                 [n_a::double * n_b / t, n_a * (t - n_b) / t, (t - n_a) * n_b / t, (t - n_a) * (t - n_b) / t] as e from pairs join firsts using (a) join seconds using (b), total where n >= 2),
scored as (select a, b, n, n_a, n_b, t, 2 * list_sum(list_transform([1, 2, 3, 4], lambda k: case when o[k] > 0 then o[k] * ln(o[k] / e[k]) else 0 end)) as score from cells),
collocated as (select * from scored where score >= {pairs.LEAST_SCORE} and n * t > n_a::double * n_b)"""
#: Of (word, count) in `counts`: plurals under their singular.
_FOLD = r"""
stems as (select word, count, case when length(word) < 4 or word like '%ss' then null when word like '%ies' and length(word) > 4 then left(word, length(word) - 3) || 'y'
            when regexp_matches(word, '(s|x|z|ch|sh)es$') then left(word, length(word) - 2) when word like '%s' then left(word, length(word) - 1) end as stem from counts),
once as (select a.word, a.count, coalesce(b.word, a.word) as to_word, b.stem as further from stems a left join stems b on a.stem = b.word),
folded as (select coalesce(c.word, to_word) as word, sum(once.count)::bigint as count, count(*) as forms from once left join stems c on c.word = further group by 1)"""

_KEYWORDS = ", ".join(f"('{k}')" for k in plain.KEYWORDS)
#: How many findings each report has on the index of parts' words.
_SUMMARY = (
    plain._WORDS.replace("with occ", "with recursive occ", 1) + plain._CLUSTERS + plain._GROUPS.rstrip()
    + f""", shared as ({plain._shared("occ")}), short as ({plain._ACRONYMS}),
found(report_id, findings) as (
  select 'similar_terms', count(distinct cluster) from cluster
  union all select 'overlapping_terms', count(distinct a) from {plain._CONTAINED}
  union all select 'capitalization_variants', count(*) from (select lower(term) from terms group by 1 having count(*) >= 2)
  union all select 'formatting_variants', count(*) from uniq a where not exists (select 1 from uniq b where len(a.v) < len(b.v) and list_has_all(b.v, a.v))
  union all select 'unused_include_terms', count(*) from (values {_KEYWORDS}) v(k) where lower(k) not in (select lower(term) from terms)
  union all select 'thin_entries', count(*) from sizes where n <= 1 union all select 'dense_entries', count(*) from sizes where n >= 20
  union all select 'shared_page_sets', count(*) from shared union all select 'acronym_pairs', count(*) from short)
select report_id, findings::bigint as findings, 0::bigint as not_run from found"""
)

ORACLE_SQL: dict[str, str] = {
    "report_summary": _SUMMARY,
    "merge_log_state": _state(9) + " select term, page_idx, page_label from state",
    "merge_log_earlier_state": _state(4) + " select term, page_idx, page_label from state",
    "merge_log_changes": f"""
with a as ({_state(4)} select term, page_idx from state), b as ({_state(5)} select term, page_idx from state)
select term, page_idx, 'added' as change from (from b except from a) union all select term, page_idx, 'gone' from (from a except from b)""",
    "merge_candidates": plain._WORDS + rf""", pages_of as (select term, count(*)::int as pages from occ group by term),
found as (select term as target, pages, len(list_intersect(list_distinct(regexp_extract_all(lower(term), '[\p{{L}}\p{{N}}_]+')), string_split('{SOURCE}', ' ')))::int as common, contains(lower(term), '{SOURCE}') as within from pages_of where term <> '{SOURCE}')
select target, pages, common, row_number() over (order by common desc, within desc, pages desc, target)::int as rank from found where (common > 0 or within) and '{SOURCE}' in (select term from pages_of)""",
    "cloud_collocations": f"with {_PAIRS} select a, b, n, n_a, n_b, floor(score * 1000)::bigint as score_1000 from collocated",
    "cloud_plurals": rf"with counts as (select word, count(*) as count from (select unnest(regexp_extract_all(lower(text), '\p{{L}}[\p{{L}}\p{{N}}_'']+')) as word from documents) group by word), {_FOLD} select word, count, forms from folded",
    "cloud_with_pairs": rf"""with {_PAIRS},
taken as (select word, sum(n)::bigint as taken from (select unnest([a, b]) as word, n from collocated) group by word),
singles as (select a as word, count(*)::bigint as count from each where a not in ({_STOP}) group by a),
counts as (select word, count - coalesce(taken, 0) as count from singles left join taken using (word) where count > coalesce(taken, 0)), {_FOLD}
select word, count from (select word, count from folded union all select a || ' ' || b, n from collocated) order by count desc, word limit 200""",
}
