"""Named queries over the given tables, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import lexicon
from folioscope.config import IndexConfig
from folioscope.functions import text as t
from folioscope.operators import consolidate, index, keywords, merge, names, render, reports, search
from folioscope.sources import tables
from folioscope.storage import stored

#: The keywords that the queries index.
KEYWORDS = ["the", "The", "und", "des", "que", "über", "tion", "General Public License", "Apache License", " password ", "", "idiot", "nowhere"]
USED = ["the", "The", "und", "des", "que", "über", "tion", "General Public License", "Apache License", "password", "idiot", "nowhere"]
MERGES = [("des", "que"), ("que", "und"), ("nowhere", "und")]
CONFIG = IndexConfig()

Query = Callable[[SparkSession, str], DataFrame]


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents_as_book(spark.read.parquet(f"{sf}/documents.parquet"))


def hits(spark: SparkSession, sf: str, config: IndexConfig = CONFIG) -> DataFrame:
    return keywords.keyword_hits(pages(spark, sf), KEYWORDS, config)


def part_occ(spark: SparkSession, sf: str) -> DataFrame:
    """A large index: parts' brands and types, on the pages of their orders."""
    part, item = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    term = F.explode(F.array("p_brand", "p_type")).alias("term")
    rows = item.join(part, item["l_partkey"] == part["p_partkey"]).select(F.lit("orders").alias("book_id"), term, F.col("l_orderkey").cast("int").alias("page_idx"))
    return rows.distinct().withColumn("page_label", (F.col("page_idx") + 1).cast("string"))


def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return names.plain_tokens(pages(spark, sf))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return index.suppress_covered(index.unite(hits(spark, sf), names.name_index(name_tokens(spark, sf))))


def word_occ(spark: SparkSession, sf: str) -> DataFrame:
    """An index of customers' segments, order priorities and part names, on their own keys as pages."""
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.array("p_name", "p_type", "p_brand", F.upper("p_brand"), F.regexp_replace("p_type", " ", "-"))).alias("term"), F.col("p_partkey").cast("int").alias("page_idx"))
    return part.select(F.lit("parts").alias("book_id"), "term", "page_idx", (F.col("page_idx") + 1).cast("string").alias("page_label")).distinct()


def form_occ(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Parts' names and types with their first two words and each word. whole: all on the parts' keys as pages; else the two
    words are on the part's size and each word on its price as pages, so that forms differ in where they are."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    key, size, price = (c.cast("int") for c in (F.col("p_partkey"), F.col("p_size"), F.floor("p_retailprice")))

    def on(words: Column, page: Column) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("term"), (key if whole else page).alias("page_idx")))

    forms = [f for c in ("p_name", "p_type") for f in (on(F.array(c), key), on(F.array(F.substring_index(c, " ", 2)), size), on(F.split(c, " "), price))]
    each = part.select(F.explode(F.concat(*forms)).alias("f")).select("f.term", "f.page_idx")
    return each.select(F.lit("parts").alias("book_id"), "term", "page_idx", (F.col("page_idx") + 1).cast("string").alias("page_label")).distinct()


def customer_occ(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names on the pages of their orders: many entries of few pages."""
    orders, customer = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.lit("customers").alias("book_id"), F.col("c_name").alias("term"), F.col("o_orderkey").cast("int").alias("page_idx"))
    return rows.distinct().withColumn("page_label", (F.col("page_idx") + 1).cast("string"))


def twin_occ(spark: SparkSession, sf: str) -> DataFrame:
    """Two names for one thing: a part's brand by number and by maker on the same pages, a line name on most of them, and a size."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    code = F.substring("p_brand", 7, 9)
    terms = F.array("p_brand", F.concat(F.lit("Maker "), code), F.when(F.col("p_size") > 5, F.concat(F.lit("Line "), code)), F.when(F.col("p_size") > 25, F.concat(F.lit("Large "), code)), F.concat(F.lit("Size "), F.col("p_size").cast("string")), F.lit("!!"))
    each = part.select(F.explode(F.array_compact(terms)).alias("term"), F.col("p_partkey").cast("int").alias("page_idx"))
    return each.select(F.lit("parts").alias("book_id"), "term", "page_idx", (F.col("page_idx") + 1).cast("string").alias("page_label")).distinct()


def acronym_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' types, their initials in capitals, the same with skipped words, and nations with initials of their own."""
    part, nation = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    initials = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.upper(F.substring(w, 1, 1))), "")
    both = part.select(F.explode(F.array("p_type", initials("p_type"), F.concat_ws(" of the ", F.split("p_type", " ")), "p_name", initials("p_name"))).alias("term"))
    return both.unionByName(nation.select(F.col("n_name").alias("term"))).select(F.lit("parts").alias("book_id"), "term").distinct()


def terms_of(occ: DataFrame) -> DataFrame:
    return occ.select("book_id", "term").distinct()


def q_token_classes(spark: SparkSession, sf: str) -> DataFrame:
    token = F.col("token")
    each = pages(spark, sf).select(F.explode(t.tokens(F.col("text"))).alias("token"))
    classes = {"punctuation": t.is_punctuation(token), "all_caps": t.is_all_caps(token), "roman": t.is_roman(token), "number_like": t.is_number_like(token), "footnote": t.is_footnote_ref(token), "capitalised": t.is_capitalised(token)}
    return each.agg(F.count("*").alias("tokens"), *[F.count_if(c).alias(n) for n, c in classes.items()])


def flat_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    found = merge.merge_suggestions(word_occ(spark, sf))
    return found.select("source", "source_pages", F.array_join(F.transform("containers", lambda c: c["entry"]), "; ").alias("containers"), "target", "target_pages")


def q_merge_undo(spark: SparkSession, sf: str) -> DataFrame:
    occ = hits(spark, sf)
    after, original, added = merge.merge_with_undo(occ, "des", "que")
    return merge.undo(after, original, added, "que").select("term", "page_idx", "page_label")


def q_pending(spark: SparkSession, sf: str) -> DataFrame:
    found = flat_suggestions(spark, sf)
    decisions = found.where("source like '%1%'").select("source", F.lit("separate").alias("decision"), "target")
    return merge.pending(found, decisions).select("source", "target")


def html_bold_names(spark: SparkSession, sf: str) -> DataFrame:
    blocks = tables.html_as_blocks(spark.read.parquet(f"{sf}/pages.parquet"))
    return names.discover(names.span_tokens(blocks), include_bold=True).select("page_idx", "name", "at")


#: Terms that are highlighted, in this order.
HIGHLIGHTED = ["que", "Public License", "General Public License", "License, MIT", "idiot"]


def highlight(spark: SparkSession, sf: str) -> DataFrame:
    return search.highlights(pages(spark, sf), spark.createDataFrame(list(enumerate(HIGHLIGHTED)), "ord int, term string"))


def lines_of(spark: SparkSession, sf: str) -> DataFrame:
    return index.formatted(hits(spark, sf))


QUERIES: dict[str, Query] = {
    "keyword_hits": lambda s, d: hits(s, d).select("term", "page_idx", "page_label"),
    "keyword_hits_from_offset": lambda s, d: hits(s, d, IndexConfig(page_offset=-50, index_from_offset=True)).select("term", "page_idx", "page_label"),
    "keyword_labels_physical": lambda s, d: hits(s, d, IndexConfig(page_strategy="physical", page_offset=7)).select("term", "page_idx", "page_label"),
    "keyword_index_formatted": lambda s, d: lines_of(s, d).select("display_term", "pages"),
    "keyword_index_capitalised": lambda s, d: index.formatted(hits(s, d), capitalize=True).select("display_term", "pages"),
    "index_text_lines": lambda s, d: render.text_lines(lines_of(s, d)).select("line"),
    "index_markdown_lines": lambda s, d: render.markdown_lines(lines_of(s, d)).select("line"),
    "index_html_lines": lambda s, d: render.html_lines(lines_of(s, d)).select("line"),
    "index_active_links": lambda s, d: render.active_lines(hits(s, d)).select("line"),
    "part_index_formatted": lambda s, d: index.formatted(part_occ(s, d)).select("display_term", "pages"),
    "keyword_sort_dedup": lambda s, d: keywords.sort_and_dedup(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("ord"), F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type"))).alias("word"))),
    "unused_keywords": lambda s, d: reports.unused_keywords(terms_of(part_occ(s, d)), s.read.parquet(f"{d}/part.parquet").select(F.explode(F.array(F.upper("p_type"), "p_name", F.concat(F.lit(" "), "p_brand"))).alias("word")).distinct()),
    "token_classes": q_token_classes,
    "tokens": lambda s, d: pages(s, d).select(F.explode(t.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
    "names_discovered": lambda s, d: names.discover(name_tokens(s, d)).groupBy("name").agg(F.count("*").alias("n")),
    "names_html_bold": html_bold_names,
    "name_occurrences": lambda s, d: names.locate(name_tokens(s, d), stored(names.vocabulary(names.discover(name_tokens(s, d))), "vocabulary")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("page_idx").alias("n_pages")),
    "name_index": lambda s, d: names.name_index(name_tokens(s, d)).select("term", "page_idx", "page_label"),
    "merged_index": lambda s, d: merged(s, d).select("term", "page_idx", "page_label"),
    "merged_index_user": lambda s, d: merge.apply_merges(hits(s, d), MERGES).select("term", "page_idx", "page_label"),
    "suppressed_index": lambda s, d: index.suppress_covered(word_occ(s, d)).select("term", "page_idx"),
    "name_groups": lambda s, d: consolidate.name_groups(terms_of(form_occ(s, d))).select("term", "longest_form"),
    "name_group_pages": lambda s, d: consolidate.group_pages(form_occ(s, d), consolidate.name_groups(terms_of(form_occ(s, d)))).select("longest_form", "term", "page_idx", "page_label"),
    "name_groups_whole": lambda s, d: consolidate.name_groups(terms_of(form_occ(s, d, whole=True))).select("term", "longest_form"),
    "name_group_pages_whole": lambda s, d: consolidate.group_pages(form_occ(s, d, whole=True), consolidate.name_groups(terms_of(form_occ(s, d, whole=True)))).select("longest_form", "term", "page_idx", "page_label"),
    "merge_suggestions": flat_suggestions,
    "merge_pending": q_pending,
    "merge_undo": q_merge_undo,
    "report_similar_pairs": lambda s, d: reports.similar_pairs(terms_of(word_occ(s, d)), None).select("a", "b"),
    "report_similar_clusters": lambda s, d: reports.similar_clusters(reports.similar_pairs(terms_of(word_occ(s, d)), None)).select("term", "cluster"),
    "report_overlapping": lambda s, d: reports.overlapping(terms_of(word_occ(s, d))).select("term", F.array_join("containers", "; ").alias("containers")),
    "report_capitalization": lambda s, d: reports.capitalization_variants(terms_of(word_occ(s, d))).select("folded", F.array_join("variants", "; ").alias("variants")),
    "report_formatting": lambda s, d: reports.formatting_variants(terms_of(word_occ(s, d))).select(F.array_join("variants", "; ").alias("variants")),
    "report_thin": lambda s, d: reports.thin(customer_occ(s, d), 5).select("term", "n_pages"),
    "report_dense": lambda s, d: reports.dense(part_occ(s, d), 20).select("term", "n_pages", "note"),
    "report_shared_pages": lambda s, d: reports.shared_pages(word_occ(s, d).unionByName(twin_occ(s, d)).distinct(), max_entries=None).select("a", "b", "note"),
    "report_acronyms": lambda s, d: reports.acronyms(acronym_terms(s, d)).select("acronym", "expansion"),
    "report_findings": lambda s, d: reports.findings(twin_occ(s, d), keywords.literal_terms(s, KEYWORDS), reports=("unused_include_terms", "thin_entries", "dense_entries", "shared_page_sets"), most_shared=None).select("report_id", "key", F.array_join("terms", "; ").alias("terms"), "note"),
    "report_summary": lambda s, d: reports.summary(word_occ(s, d), keywords.literal_terms(s, KEYWORDS)),
    "cloud_all": lambda s, d: search.cloud_all(pages(s, d)),
    "cloud_in_index": lambda s, d: search.cloud_in_index(part_occ(s, d)),
    "cloud_not_in_index": lambda s, d: search.cloud_not_in_index(pages(s, d), hits(s, d)),
    "cloud_keyword_flag": lambda s, d: search.keyword_flag(search.cloud_all(pages(s, d)), keywords.literal_terms(s, USED)),
    "filter_lines": lambda s, d: search.filter_lines(render.text_lines(lines_of(s, d)), "LICENSE").select("line"),
    "terms_on_page": lambda s, d: index.terms_on_page(hits(s, d), 7).select("term"),
    "phrase_search": lambda s, d: search.phrase_search(pages(s, d), "Public License").select("page_idx", "match_ord", "start"),
    "phrase_count": lambda s, d: search.phrase_count(pages(s, d), "que").select("matches"),
    "highlight_terms": lambda s, d: highlight(s, d).select("page_idx", F.col("at").alias("word_idx"), "term"),
    "highlight_accent": lambda s, d: search.accent(highlight(s, d), "que").select("page_idx", F.col("at").alias("word_idx")),
}

_LETTER = r"[^\p{L}\p{N}_]"
_VALUES = ", ".join(f"('{w}')" for w in USED)


def _hits_sql(label: str = "doc_id + 1", where: str = "true") -> str:
    """A pattern for each keyword: DuckDB compiles a constant one once."""
    each = [f"select '{w}' as term, doc_id::int as page_idx, cast({label} as varchar) as page_label from documents where {where} and regexp_matches(text, '(?i)(^|{_LETTER}){w}($|{_LETTER})')" for w in USED]
    return " union all ".join(each)


_RUNS = "select term, page_idx - row_number() over (partition by term order by page_idx) as island, page_idx, page_label from occ"
_SPANS = f"select term, min(page_idx) as f, arg_min(page_label, page_idx) as fl, max(page_idx) as l, arg_max(page_label, page_idx) as ll from ({_RUNS}) group by term, island"
_LINES = f"select term as display_term, string_agg(case when f = l then fl else fl || '-' || ll end, ', ' order by f) as pages from ({_SPANS}) group by term"
_OCC = f"with occ as ({_hits_sql()}), lines as ({_LINES}) "
_PARTS = "with occ as (select distinct term, l_orderkey::int as page_idx, cast(l_orderkey + 1 as varchar) as page_label from lineitem join (select p_partkey, unnest([p_brand, p_type]) as term from part) on l_partkey = p_partkey) "
_WORDS = "with occ as (select distinct unnest([p_name, p_type, p_brand, upper(p_brand), replace(p_type, ' ', '-')]) as term, p_partkey::int as page_idx from part), terms as (select distinct term, list_distinct(regexp_extract_all(lower(term), '[\\p{L}\\p{N}_]+')) as w from occ), sizes as (select term, count(*)::int as n from occ group by term) "
_CONTAINED = "(select a.term as a, b.term as b, a.w as wa, b.w as wb from terms a join terms b on a.term <> b.term and len(a.w) > 0 and list_has_all(b.w, a.w) and (len(a.w) < len(b.w) or len(a.w) = len(b.w) and length(a.term) < length(b.term)))"
_SUBSET = "(len(a.w) = 0 or len(b.w) = 0 or list_has_all(a.w, b.w) or list_has_all(b.w, a.w))"
_CLOUD_STOP = ", ".join(f"'{w}'" for w in sorted(search.lexicon.CLOUD_STOPWORDS))
_CLOUD = f"select word, count(*) as count from (select unnest(regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{N}}_'']+')) as word from documents) where word not in ({_CLOUD_STOP})"
_SUGGEST = _WORDS + ", pairs as (select a, b from " + _CONTAINED + " where len(wa) < len(wb) or contains(' ' || regexp_replace(lower(b), '[^\\p{L}\\p{N}_]', ' ', 'g') || ' ', ' ' || regexp_replace(lower(a), '[^\\p{L}\\p{N}_]', ' ', 'g') || ' ') and contains(lower(b), lower(a))), found as (select a as source, string_agg(b, '; ' order by -length(b), lower(b), b) as containers, arg_min(b, (-length(b), lower(b), b)) as target from pairs group by a) "
_SIMILAR = "select a.term as a, b.term as b from terms a join terms b on a.term < b.term and abs(length(a.term) - length(b.term)) <= 3 and levenshtein(lower(a.term), lower(b.term)) <= 3 and not " + _SUBSET
_GROUPS = ", groups as (select list(distinct term order by term) as v from (select term, 'w:' || array_to_string(list_sort(regexp_extract_all(lower(term), '[\\p{L}\\p{N}_]+')), ' ') as k from occ where len(regexp_extract_all(lower(term), '[\\p{L}\\p{N}_]+')) >= 2 union all select term, 'h:' || regexp_replace(lower(term), '[-\\s]', '', 'g') from occ) group by k having count(distinct term) >= 2), uniq as (select distinct v from groups) "
_GENERIC = ", ".join(f"'{w}'" for w in sorted(lexicon.NOT_PERSONS))
_FORMS = f"""with part_forms as (select unnest([{{'term': p_name, 'page_idx': p_partkey::int}}, {{'term': p_type, 'page_idx': p_partkey::int}}, {{'term': array_to_string(string_split(p_name, ' ')[:2], ' '), 'page_idx': PAGE2}}, {{'term': array_to_string(string_split(p_type, ' ')[:2], ' '), 'page_idx': PAGE2}}]
  || list_transform(string_split(p_name, ' ') || string_split(p_type, ' '), lambda w: {{'term': w, 'page_idx': PAGE1}})) as f from part),
occ as (select distinct f.term as term, f.page_idx as page_idx, cast(f.page_idx + 1 as varchar) as page_label from part_forms),
terms as (select distinct term, string_split(lower(term), ' ') as w from occ),
pairs as (select a.term as s, b.term as l, len(a.w) as ns, b.w as lw from terms a join terms b on len(a.w) < len(b.w) and contains(' ' || lower(b.term) || ' ', ' ' || lower(a.term) || ' ')
          where len(a.w) >= 2 or list_position(b.w, a.w[1]) = len(b.w) or not list_has_any(b.w[:list_position(b.w, a.w[1]) - 1] || b.w[list_position(b.w, a.w[1]) + 1:], [{_GENERIC}])),
chosen as (select s, arg_min(l, (-len(lw), lower(l), l)) as l from pairs where l not in (select s from pairs where ns >= 2) group by s),
groups as (select term, coalesce(l, term) as longest_form from terms left join chosen on s = term) """



def _in(words: frozenset[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


#: Tokens of a page in their order, each with what it does to an open name: F ends it, S (a title) leaves it, T only goes on
#: with it, C begins it or goes on. A sentence has just ended if the last token that says so is its end, or there is none.
_TOKENS = f"""with tok as (select doc_id::int as page_idx, generate_subscripts(t, 1) as i, unnest(t) as raw from (select doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_''’-]*[\\p{{L}}\\p{{N}}_])?|[^\\s\\p{{L}}\\p{{N}}_]') as t from documents)),
word as (select page_idx, i, raw, w, lower(w) as low, regexp_matches(w, '^\\p{{Lu}}') as cap, regexp_matches(raw, '^\\p{{P}}+$') as punct from (select *, regexp_replace(raw, '[''’]s$', '') as w from tok)),
kind as (select *, case when punct then case when raw in ('.', '?', '!') then 'end' else 'keep' end when low in ({_in(lexicon.STRUCTURAL)}) then 'F'
  when regexp_matches(w, '^[IVXLCDM]{{1,8}}$') or regexp_matches(w, '^\\p{{Nd}}+$') or length(w) <= 4 and regexp_matches(w, '\\p{{Nd}}') then 'keep' when low in ({_in(lexicon.TITLES)}) then 'S' when low in ({_in(lexicon.CONNECTORS)}) then 'F'
  when not cap then 'F' when regexp_matches(w, '^\\p{{L}}{{2,}}$') and w = upper(w) then 'F' when low in ({_in(lexicon.STOPWORDS)}) then 'T' else 'C' end as k from word),
fresh as (select *, coalesce(last_value(case when k = 'end' then true when k = 'keep' then null else false end ignore nulls) over (partition by page_idx order by i rows between unbounded preceding and 1 preceding), true) as f from kind),
role as (select page_idx, i, w, case when k in ('end', 'keep') or k in ('T', 'C') and f then 'F' else k end as r from fresh),
part_of as (select *, count(*) filter (r = 'F') over (partition by page_idx order by i rows unbounded preceding) as seg from role),
begun as (select *, min(i) filter (r = 'C') over (partition by page_idx, seg) as c from part_of),
found as (select page_idx, string_agg(w, ' ' order by i) as raw, min(i) as i from begun where r in ('T', 'C') and i >= c group by page_idx, seg),
names as (select page_idx, i, regexp_replace(raw, '^[\\s!-/:-@\\[-`{{-~‘’“”]+|[\\s!-/:-@\\[-`{{-~‘’“”]+$', '', 'g') as name from found),
good as (select * from names where length(name) > 1 and not regexp_matches(name, '^\\p{{Nd}}+$'))"""
#: Of spellings alike but for case the smallest; then the longest name at each capitalised word.
_LOCATED = _TOKENS + f""", known as (select lower(name) as key, min(name) as name, len(string_split(min(name), ' ')) as n from good where contains(name, ' ') or lower(name) not in ({_in(lexicon.STOPWORDS)}) group by 1),
seq as (select page_idx, list(case when punct then null else w end order by i) as ws from word group by page_idx),
starts as (select page_idx, p, ws, lower(ws[p]) as low from (select page_idx, ws, unnest(range(1, len(ws) + 1)) as p from seq) where regexp_matches(ws[p], '^\\p{{Lu}}')),
hit as (select page_idx, p, arg_max(name, n) as name from starts join known on low = split_part(key, ' ', 1) and lower(array_to_string(ws[p:p + n - 1], ' ')) = key group by page_idx, p)"""
_NAMED = _LOCATED + f""", shown as (select distinct page_idx, case when len(string_split(name, ' ')) = 2 and not list_has_any(string_split(lower(name), ' '), [{_GENERIC}]) then split_part(name, ' ', 2) || ', ' || split_part(name, ' ', 1) else name end as term, cast(page_idx + 1 as varchar) as page_label from hit)"""


def _suppressed(occ: str, name: str) -> str:
    """`name`: occ without pages of single words that an entry of several has there."""
    return f"""{name}_parts as (select distinct unnest(regexp_split_to_array(lower(term), '[\\s,]+')) as word, page_idx from {occ} where regexp_matches(term, '[ ,]')),
{name} as (select term, page_idx, page_label from {occ} where regexp_matches(term, '[ ,]') or (lower(term), page_idx) not in (select word, page_idx from {name}_parts))"""


_ACRONYM_TERMS = """with types as (select distinct string_split(p_type, ' ') as t, string_split(p_name, ' ') as m from part),
terms as (select distinct unnest([array_to_string(t, ' '), array_to_string(list_transform(t, lambda w: upper(w[1])), ''), array_to_string(t, ' of the '), array_to_string(m, ' '), array_to_string(list_transform(m, lambda w: upper(w[1])), '')]) as term from types union select n_name from nation)"""
_SKIPPED = ", ".join(f"'{w}'" for w in lexicon.ACRONYM_SKIP)
_ACRONYMS = f"""select a.term as acronym, b.term as expansion from (select term from terms where regexp_matches(term, '^[A-Z]{{2,6}}$')) a join (select term, lower(array_to_string(list_transform(list_filter(regexp_extract_all(term, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) not in ({_SKIPPED})), lambda w: w[1]), '')) as ini from terms where len(regexp_extract_all(term, '[\\p{{L}}\\p{{N}}_]+')) >= 2) b on lower(a.term) = b.ini"""
_TWINS = """select distinct t as term, page_idx from (select p_partkey::int as page_idx, unnest([p_brand, 'Maker ' || p_brand[7:15], case when p_size > 5 then 'Line ' || p_brand[7:15] end, case when p_size > 25 then 'Large ' || p_brand[7:15] end, 'Size ' || p_size, '!!']) as t from part) where t is not null"""
_TWIN_OCC = f"with occ as ({_TWINS}), terms as (select distinct term, list_distinct(regexp_extract_all(lower(term), '[\\p{{L}}\\p{{N}}_]+')) as w from occ), sizes as (select term, count(*)::int as n from occ group by term)"


def _shared(occ: str) -> str:
    """Pairs of terms with their overlap."""
    return f"select s.a, s.b, trunc(score * 100)::int || '% overlap' as note from (select j.a, j.b, k::double / (p.n + q.n - k) as score from (select x.term as a, y.term as b, count(*) as k from {occ} x join {occ} y on x.page_idx = y.page_idx and x.term < y.term group by all) j join sizes p on p.term = j.a join sizes q on q.term = j.b) s join terms a on a.term = s.a join terms b on b.term = s.b where score >= 0.8 and not {_SUBSET}"


_CLUSTERS = ", pair as (" + _SIMILAR + "), edge as (select a, b from pair union all select b, a from pair), reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a), cluster as (select a as term, least(a, min(b)) as cluster from reach group by a)"
_EDGE = "[.,;:!?()\\[\\]{}\"''\\-/]+"
_FORM_VALUES = ", ".join(f"({k}, '{term}', '{form}')" for k, term in enumerate(HIGHLIGHTED) for form in dict.fromkeys([term, " ".join(reversed(term.split(", ", 1)))]))
_HIGHLIGHTS = f"""with form as (select ord, term, list_transform(string_split(form, ' '), lambda w: regexp_replace(w, '^{_EDGE}|{_EDGE}$', '', 'g')) as w from (values {_FORM_VALUES}) v(ord, term, form)),
page as (select doc_id::int as page_idx, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^{_EDGE}|{_EDGE}$', '', 'g')) as ws from documents),
run as (select page_idx, k, n, ws[k:k + n - 1] as r from page, (select distinct len(w) as n from form) s, unnest(range(1, len(ws) - n + 2)) u(k)),
hit as (select page_idx, k, n, ord, term from run join form on len(w) = n and lower(array_to_string(r, ' ')) = lower(array_to_string(w, ' ')) where len(list_filter(range(1, n + 1), lambda j: regexp_matches(w[j], '^\\p{{Lu}}') and not regexp_matches(r[j], '^\\p{{Lu}}'))) = 0),
owned as (select page_idx, (k + d - 1)::int as word_idx, arg_max(term, ord) as term from hit, unnest(range(0, n)) u(d) group by all)"""

ORACLE_SQL: dict[str, str] = {
    "names_discovered": _TOKENS + " select name, count(*) as n from good group by name",
    "name_occurrences": _LOCATED + " select name, count(*) as n, count(distinct page_idx) as n_pages from hit group by name",
    "name_index": _NAMED + ", " + _suppressed("shown", "kept") + " select term, page_idx, page_label from kept",
    "merged_index": _NAMED + ", " + _suppressed("shown", "kept") + f", united as (select distinct term, page_idx, page_label from (select * from kept union all {_hits_sql()})), " + _suppressed("united", "rest") + " select term, page_idx, page_label from rest",
    "report_similar_clusters": _WORDS.replace("with occ", "with recursive occ", 1) + _CLUSTERS + " select term, cluster from cluster",
    "report_acronyms": _ACRONYM_TERMS + " " + _ACRONYMS,
    "report_findings": _TWIN_OCC + f""", shared as ({_shared("occ")})
select 'unused_include_terms' as report_id, k as key, k as terms, '' as note from (values {", ".join(f"('{k}')" for k in KEYWORDS)}) v(k) where lower(k) not in (select lower(term) from terms)
union all select 'thin_entries', term, term, '' from sizes where n <= 1 union all select 'dense_entries', term, term, n || ' pages' from sizes where n >= 20
union all select 'shared_page_sets', a, a || '; ' || b, note from shared""",
    "phrase_search": "select page_idx, match_ord, start from (select doc_id::int as page_idx, (k - 1)::int as match_ord, (sum(length(gap)) over (partition by doc_id order by k) + (k - 1) * 14)::int as start, k, m from (select doc_id, generate_subscripts(g, 1) as k, unnest(g) as gap, len(g) as m from (select doc_id, regexp_split_to_array(text, '(?i)public license') as g from documents))) where k < m",
    "highlight_terms": _HIGHLIGHTS + " select page_idx, word_idx, term from owned",
    "highlight_accent": _HIGHLIGHTS + " select page_idx, word_idx from owned where term = 'que'",
    "name_groups": _FORMS + "select * from groups",
    "name_group_pages": _FORMS + f"""select longest_form, case when term <> longest_form then term when len(string_split(term, ' ')) = 2 and not list_has_any(string_split(lower(term), ' '), [{_GENERIC}]) then split_part(term, ' ', 2) || ', ' || split_part(term, ' ', 1) else term end as term, page_idx, page_label
from occ join groups using (term) where term = longest_form or (longest_form, page_idx) not in (select term, page_idx from occ)""",
    "keyword_hits": _hits_sql(),
    "keyword_hits_from_offset": _hits_sql(where="doc_id >= 50"),
    "keyword_labels_physical": _hits_sql(label="doc_id + 8"),
    "keyword_index_formatted": _OCC + "select * from lines",
    "keyword_index_capitalised": _OCC + "select upper(display_term[1]) || display_term[2:] as display_term, arg_max(pages, (lower(display_term), display_term)) as pages from lines group by 1",
    "index_text_lines": _OCC + "select display_term || ': ' || pages as line from lines",
    "index_markdown_lines": _OCC + "select '**' || display_term || '**: ' || pages || '  ' as line from lines",
    "index_html_lines": _OCC + "select '<div><b>' || display_term || '</b>: ' || pages || '</div>' as line from lines",
    "index_active_links": f"with occ as ({_hits_sql()}) select '<div><b>' || term || '</b>: ' || string_agg('<a href=\"#' || f || '|' || term || '\">' || fl || '</a>' || case when f = l then '' else '-<a href=\"#' || l || '|' || term || '\">' || ll || '</a>' end, ', ' order by f) || '</div>' as line from ({_SPANS}) group by term",
    "part_index_formatted": _PARTS + _LINES,
    "keyword_sort_dedup": "select arg_min(word, ord) as word from (select p_partkey as ord, case when p_partkey % 2 = 0 then upper(p_type) else p_type end as word from part) group by lower(word)",
    "unused_keywords": "select distinct word from (select unnest([upper(p_type), p_name, ' ' || p_brand]) as word from part) where lower(word) not in (select lower(p_type) from part join lineitem on l_partkey = p_partkey union select lower(p_brand) from part join lineitem on l_partkey = p_partkey)",
    "tokens": "select token, count(*) as n from (select unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_''’-]*[\\p{L}\\p{N}_])?|[^\\s\\p{L}\\p{N}_]')) as token from documents) group by token",
    "token_classes": "select count(*) as tokens, count(*) filter (regexp_matches(t, '^\\p{P}+$')) as punctuation, count(*) filter (regexp_matches(t, '^\\p{L}{2,}$') and t = upper(t)) as all_caps, count(*) filter (regexp_matches(t, '^[IVXLCDM]{1,8}$')) as roman, count(*) filter (regexp_matches(t, '^\\p{Nd}+$') or length(t) <= 4 and regexp_matches(t, '\\p{Nd}')) as number_like, count(*) filter (regexp_matches(t, '^[\\p{Nd}†‡§¶*]+$')) as footnote, count(*) filter (regexp_matches(t, '^\\p{Lu}')) as capitalised from (select unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_''’-]*[\\p{L}\\p{N}_])?|[^\\s\\p{L}\\p{N}_]')) as t from documents)",
    "merged_index_user": f"with occ as ({_hits_sql()}) select distinct case when term in ('des', 'que') then 'und' else term end as term, page_idx, page_label from occ",
    "suppressed_index": _WORDS + ", parts as (select distinct unnest(regexp_split_to_array(lower(term), '[\\s,]+')) as word, page_idx from occ where regexp_matches(term, '[ ,]')) select term, page_idx from occ where regexp_matches(term, '[ ,]') or (lower(term), page_idx) not in (select word, page_idx from parts)",
    "merge_suggestions": _SUGGEST + "select source, s.n as source_pages, containers, target, t.n as target_pages from found join sizes s on s.term = source join sizes t on t.term = target",
    "merge_pending": _SUGGEST + "select source, target from found where source not like '%1%'",
    "merge_undo": _hits_sql(),
    "report_similar_pairs": _WORDS + _SIMILAR,
    "report_overlapping": _WORDS + "select a as term, string_agg(b, '; ' order by len(wb), lower(b), b) as containers from " + _CONTAINED + " group by a",
    "report_capitalization": _WORDS + "select lower(term) as folded, string_agg(term, '; ' order by term) as variants from terms group by 1 having count(*) >= 2",
    "report_formatting": _WORDS + _GROUPS + "select array_to_string(v, '; ') as variants from uniq a where not exists (select 1 from uniq b where len(a.v) < len(b.v) and list_has_all(b.v, a.v))",
    "report_thin": "select c_name as term, count(distinct o_orderkey)::int as n_pages from orders join customer on o_custkey = c_custkey group by c_name having count(distinct o_orderkey) <= 5",
    "report_dense": _PARTS + "select term, count(*)::int as n_pages, count(*) || ' pages' as note from occ group by term having count(*) >= 20",
    "report_shared_pages": _WORDS.replace("with occ as (", "with occ as (" + _TWINS + " union ", 1) + _shared("occ"),
    "cloud_all": _CLOUD + " group by word order by count desc, word limit 200",
    "cloud_in_index": _PARTS + "select term as word, count(*) as count from occ group by term",
    "cloud_not_in_index": f"with occ as ({_hits_sql()}), known as (select distinct unnest(regexp_split_to_array(lower(term), '[^\\p{{L}}\\p{{N}}_]+')) as word from occ) " + _CLOUD + " and word not in (select word from known) group by word order by count desc, word limit 200",
    "cloud_keyword_flag": f"select word, count, word in (select lower(k) from (values {_VALUES}) v(k)) as is_keyword from ({_CLOUD} group by word order by count desc, word limit 200)",
    "filter_lines": _OCC + "select display_term || ': ' || pages as line from lines where contains(lower(display_term || ': ' || pages), 'license')",
    "terms_on_page": f"with occ as ({_hits_sql()}) select distinct term from occ where page_idx = 7",
    "phrase_count": "select sum(len(regexp_extract_all(text, '(?i)que')))::bigint as matches from documents",
}

#: The pages of two words and of one, and the same where all are on the parts' keys.
for _name in ("name_groups", "name_group_pages"):
    ORACLE_SQL[f"{_name}_whole"] = ORACLE_SQL[_name].replace("PAGE2", "p_partkey::int").replace("PAGE1", "p_partkey::int")
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("PAGE2", "p_size::int").replace("PAGE1", "floor(p_retailprice)::int")
