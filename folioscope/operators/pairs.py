"""Word pairs that stand together more often than chance, and plurals under their singular.

The rules are this library's own. A pair is two cloud words beside each other on a page. Its weight is the log-likelihood ratio
of Dunning (1993) of a two by two table: how often both, either and neither stand in the pair's places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon
from folioscope.operators.search import CLOUD_WORD
from folioscope.storage import stored

#: What a pair scores at least to be shown as one: a chance of one in a million for words that are independent.
LEAST_SCORE = 23.93


def word_pairs(pages: DataFrame, stop: frozenset[str] = frozenset()) -> DataFrame:
    """(a, b, n): neighbouring words, neither of which is a stop word, with how often they are. Pages do not run on."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(CLOUD_WORD), F.lit(0))
    pair = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # A list of literals is looked up by hash, an array word by word.
    skip = sorted(lexicon.CLOUD_STOPWORDS | {s.lower() for s in stop})
    each = pages.select(words.alias("w")).select(F.explode(pair).alias("p")).where("p.b is not null").select("p.a", "p.b")
    return each.where(~F.col("a").isin(skip) & ~F.col("b").isin(skip)).groupBy("a", "b").agg(F.count("*").alias("n"))


def _term(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.ln(observed / expected)).otherwise(0.0)


def likelihood(n: Column, first: Column, second: Column, total: Column) -> Column:
    """Twice the log-likelihood ratio of a pair that occurs n times, its first word in `first` pairs as the first, its second in
    `second` as the second, of `total` pairs."""
    n, first, second, total = (c.cast("double") for c in (n, first, second, total))
    cells = [(n, first * second), (first - n, first * (total - second)), (second - n, (total - first) * second), (total - first - second + n, (total - first) * (total - second))]
    return 2 * sum((_term(o, e / total) for o, e in cells), F.lit(0.0))


def collocated(pages: DataFrame, least_count: int = 2, least_score: float = LEAST_SCORE, stop: frozenset[str] = frozenset()) -> DataFrame:
    """(a, b, n, n_a, n_b, score): pairs of least_count occurrences or more that are more frequent than chance has it, and score
    least_score or more. Counts of first and second words join the pairs by word; they are stored, so that a join with a
    word of very many pairs is between scans and can be split."""
    pairs = stored(word_pairs(pages, stop), "word-pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    first = stored(pairs.groupBy("a").agg(F.sum("n").alias("n_a")), "first-words")
    second = stored(pairs.groupBy("b").agg(F.sum("n").alias("n_b")), "second-words")
    both = pairs.where(F.col("n") >= least_count).join(first, "a").join(second, "b")
    scored = both.withColumn("score", likelihood(F.col("n"), F.col("n_a"), F.col("n_b"), F.lit(total)))
    return scored.where((F.col("score") >= least_score) & (F.col("n").cast("double") * total > F.col("n_a").cast("double") * F.col("n_b"))).select("a", "b", "n", "n_a", "n_b", "score")


def folded_plurals(counts: DataFrame) -> DataFrame:
    """(word, count, forms): counts (word, count) with plurals added to their singular where the counts have that: `-s`, `-es` after s, x,
    z, ch or sh, and `-ies` for `-y`. Words that end in `ss` are no plurals. forms is how many words were put together.

    Stems meet by a join on the word; a plural whose singular is itself a plural that is folded goes to that one's singular."""
    word = F.col("word")
    stem = (
        F.when((F.length(word) < 4) | word.endswith("ss"), F.lit(None).cast("string"))
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(F.expr("left(word, length(word) - 3)"), F.lit("y")))
        .when(word.rlike("(s|x|z|ch|sh)es$"), F.expr("left(word, length(word) - 2)"))
        .when(word.endswith("s"), F.expr("left(word, length(word) - 1)"))
    )
    own = stored(counts.select("word", "count", stem.alias("stem")), "cloud-words")
    known = own.select(F.col("word").alias("stem"), F.col("stem").alias("further"), F.lit(True).alias("known"))
    once = own.join(known, "stem", "left").select("word", "count", F.when(F.col("known"), F.col("stem")).otherwise(F.col("word")).alias("to"), F.when(F.col("known"), F.col("further")).alias("further"))
    # A singular that ends in s may be a plural too (`s` twice taken off); no word is one three times over.
    again = own.select(F.col("word").alias("further"), F.lit(True).alias("again"))
    final = once.join(again, "further", "left").select(F.when(F.col("again"), F.col("further")).otherwise(F.col("to")).alias("word"), "count")
    return final.groupBy("word").agg(F.sum("count").alias("count"), F.count("*").alias("forms"))


def cloud_with_pairs(pages: DataFrame, stop: frozenset[str] = frozenset(), top: int = 200, least_count: int = 2) -> DataFrame:
    """(word, count): a cloud whose plurals are folded and whose collocated pairs are words of their own (`a b`), their occurrences
    taken from the words they are made of; the most frequent `top`, ties by spelling. A word of no count left is not shown."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(CLOUD_WORD), F.lit(0))
    skip = sorted(lexicon.CLOUD_STOPWORDS | {s.lower() for s in stop})
    single = pages.select(F.explode(words).alias("word")).where(~F.col("word").isin(skip)).groupBy("word").agg(F.count("*").alias("count"))
    pairs = stored(collocated(pages, least_count, stop=stop).select("a", "b", "n"), "cloud-pairs")
    taken = pairs.select(F.explode(F.array("a", "b")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("taken"))
    rest = single.join(taken, "word", "left").select("word", (F.col("count") - F.coalesce("taken", F.lit(0))).alias("count")).where("count > 0")
    whole = folded_plurals(rest).select("word", "count").unionByName(pairs.select(F.concat_ws(" ", "a", "b").alias("word"), F.col("n").alias("count")))
    return whole.orderBy(F.desc("count"), "word").limit(top)
