"""Clouds, filter, phrase search and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon
from folioscope.functions.text import match_spans, nfkc
from folioscope.operators.keywords import from_selection

#: Words of a cloud: a letter, then one or more word characters or apostrophes.
CLOUD_WORD = rf"\p{{L}}[\p{{L}}\p{{N}}_']+"


def _counts(pages: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(CLOUD_WORD), F.lit(0))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def _without(counts: DataFrame, stop: frozenset[str]) -> DataFrame:
    return counts.where(~F.array_contains(F.array(*[F.lit(w) for w in sorted(lexicon.CLOUD_STOPWORDS | {s.lower() for s in stop})]), F.col("word")))


def cloud_all(pages: DataFrame, stop: frozenset[str] = frozenset(), top: int = 200) -> DataFrame:
    """(word, count): a report of the most frequent words; ties by spelling."""
    return _without(_counts(pages), stop).orderBy(F.desc("count"), "word").limit(top)


def cloud_in_index(occ: DataFrame) -> DataFrame:
    """(word, count): each term with its number of pages."""
    return occ.where("term <> ''").groupBy(F.col("term").alias("word")).agg(F.count("*").alias("count"))


def cloud_not_in_index(pages: DataFrame, occ: DataFrame, stop: frozenset[str] = frozenset(), top: int = 200) -> DataFrame:
    known = occ.select("term").distinct().select(F.explode(F.split(F.lower("term"), rf"[^\p{{L}}\p{{N}}_]+")).alias("word")).distinct()
    return _without(_counts(pages), stop).join(known, "word", "left_anti").orderBy(F.desc("count"), "word").limit(top)


def keyword_flag(cloud: DataFrame, keywords: DataFrame) -> DataFrame:
    known = keywords.select(F.lower("word").alias("k")).distinct()
    return cloud.join(known, F.lower(cloud["word"]) == F.col("k"), "left").select("word", "count", F.col("k").isNotNull().alias("is_keyword"))


def toggle(words: list[str], word: str) -> list[str]:
    """The list without the word in any case, or with it."""
    kept = [w for w in words if w.lower() != word.lower()]
    return kept if len(kept) < len(words) else [*words, word]


def add_word(words: list[str], word: str) -> list[str]:
    """The list with the word, unless it has it in some case, or it is blank."""
    return words if not word.strip() or word.strip().lower() in {w.lower() for w in words} else [*words, word.strip()]


def click(cloud: str, word: str, keywords: list[str], excludes: list[str]) -> tuple[list[str], list[str]]:
    """(keywords, excludes) after a click on a cloud's word, without ASCII punctuation at its end.

    In the cloud `in_index` the word is excluded, in `not_in_index` it becomes a keyword, in `all` it is one or ceases to be."""
    word = from_selection(word)
    if cloud == "in_index":
        return keywords, add_word(excludes, word)
    if cloud == "not_in_index":
        return add_word(keywords, word), excludes
    return toggle(keywords, word), excludes


def filter_lines(lines: DataFrame, wanted: str) -> DataFrame:
    return lines.where(F.lower("line").contains(wanted.lower()))


def _literal(phrase: str) -> str:
    return "(?iu)\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def occurrences(text: Column, pattern: str) -> Column:
    """Starts of the matches, in characters."""
    return F.transform(match_spans(text, pattern), lambda s: s["start"])


def phrase_search(pages: DataFrame, phrase: str) -> DataFrame:
    """(book_id, page_idx, match_ord, start): literal matches without regard to case, in order on each page."""
    found = occurrences(F.coalesce("text", F.lit("")), _literal(phrase))
    return pages.select("book_id", "page_idx", F.posexplode(found).alias("match_ord", "start"))


def phrase_count(pages: DataFrame, phrase: str) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_literal(phrase)), F.lit(0)))
    return pages.groupBy("book_id").agg(F.sum(n).cast("long").alias("matches"))


def next_hit(total: int, at: int, step: int = 1) -> int:
    """The match after or before, around the end."""
    return (at + step) % total


def first_hit(found: DataFrame, page_idx: int) -> DataFrame:
    """Of phrase_search's matches, for each book the first on or after a page, else the first of all, with its number from 0 in
    `nth` and how many there are in `total`."""
    counts = found.groupBy("book_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("page_idx") < page_idx).alias("before"), F.min(F.when(F.col("page_idx") >= page_idx, F.struct("page_idx", "match_ord", "start"))).alias("here"), F.min(F.struct("page_idx", "match_ord", "start")).alias("first"),
    )
    at = F.coalesce("here", "first")
    nth = F.when(F.col("here").isNull(), 0).otherwise(F.col("before"))
    return counts.select("book_id", at["page_idx"].alias("page_idx"), at["match_ord"].alias("match_ord"), at["start"].alias("start"), nth.cast("long").alias("nth"), "total")


#: Characters that do not count at the edges of a word or of a term's word.
EDGE = ".,;:!?()[]{}\"'-/"
#: First words of terms, up to which words of pages are sifted by them before they are joined.
FIRST_WORDS = 10_000


def page_words(text: Column) -> Column:
    """Words of a page between white space; a word's place is its number from 0."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def highlight_forms(terms: DataFrame) -> DataFrame:
    """(ord, term, n, words, caps): forms of terms(ord, term) to look for, with n words in lower case and which of them want a
    capital. A term with `, ` in it has a second form with what follows put first."""
    normal = terms.select("ord", "term", nfkc(F.col("term")).alias("form"))
    turned = F.when(F.col("form").contains(", "), F.regexp_replace("form", "(?s)^(.*?), (.*)$", "$2 $1"))
    forms = normal.select("ord", "term", F.explode(F.array_compact(F.array("form", turned))).alias("form"))
    wanted = forms.select("ord", "term", _bare(page_words(F.col("form"))).alias("w")).where(F.size("w") > 0)
    return wanted.select("ord", "term", F.size("w").alias("n"), F.transform("w", F.lower).alias("words"), _caps(F.col("w")).alias("caps"))


def _bare(words: Column) -> Column:
    return F.transform(words, lambda w: F.btrim(w, F.lit(EDGE)))


def _caps(words: Column) -> Column:
    return F.transform(words, lambda w: w.rlike(r"^\p{Lu}"))


def highlights(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(book_id, page_idx, at, term): words of a page that a term covers; of several terms the last owns the word.

    terms: (ord, term). A term with `, ` in it is also looked for with what follows put first. Both sides are in NFKC form,
    and EDGE is taken off each word; what is then empty still takes its place. A word of a term that is capitalised wants a
    capitalised word. Runs of words, as long as terms are, are joined to the terms.
    """
    wanted = highlight_forms(terms).select("ord", "term", "n", F.array_join("words", " ").alias("key"), F.col("words")[0].alias("first"), "caps")
    sizes = sorted(r[0] for r in wanted.select("n").distinct().collect())  # lengths of terms in words
    firsts = [r[0] for r in wanted.select("first").distinct().limit(FIRST_WORDS + 1).collect()]
    own = pages.select("book_id", "page_idx", _bare(page_words(nfkc(F.col("text")))).alias("words"))
    starts = F.transform("words", lambda w, i: F.struct(i.alias("at"), F.lower(w).alias("first")))
    if len(firsts) <= FIRST_WORDS:
        starts = F.filter(starts, lambda s: s["first"].isin(*firsts) if firsts else F.lit(False))
    runs = F.flatten(F.transform(starts, lambda s: F.array(*[F.struct(s["at"].alias("at"), F.lit(n).alias("n"), F.slice("words", s["at"] + 1, F.lit(n)).alias("run")) for n in sizes or [1]])))
    run = own.select("book_id", "page_idx", F.explode(runs).alias("t")).where(F.size("t.run") == F.col("t.n")).select("book_id", "page_idx", "t.at", "t.n", F.lower(F.array_join("t.run", " ")).alias("key"), F.col("t.run").alias("run"))
    fits = F.forall(F.zip_with("caps", _caps(F.col("run")), lambda wants, has: ~wants | has), lambda x: x)
    hit = run.join(wanted, ["n", "key"]).where(fits)
    each = hit.select("book_id", "page_idx", "ord", "term", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at"))
    return each.groupBy("book_id", "page_idx", "at").agg(F.max_by("term", "ord").alias("term"))


def accent(owned: DataFrame, term: str) -> DataFrame:
    """Words that a term owns, and no other term."""
    return owned.where(F.col("term") == term)
