"""Unicode-aware text functions as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word character: letter, number or underscore.
W = r"[\p{L}\p{N}_]"
_WORD = re.compile(r"\w")
#: Words with inner apostrophes and hyphens, or one other character that is not white space.
TOKEN = rf"{W}(?:[\p{{L}}\p{{N}}_'’-]*{W})?|[^\s\p{{L}}\p{{N}}_]"


def keyword_pattern(keyword: str) -> str:
    """Java pattern of a whole-word, case-insensitive match. An edge that is no word character wants one beside it."""
    before = rf"(?<!{W})" if _WORD.match(keyword[0]) else rf"(?<={W})"
    after = rf"(?!{W})" if _WORD.match(keyword[-1]) else rf"(?={W})"
    escaped = re.sub(r"([^\w\s])", r"\\\1", keyword, flags=re.ASCII) if keyword.isascii() else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", keyword)
    # Alone, a sharp s has no upper case for Java's patterns; in a longer text it has.
    return f"(?iu){before}{escaped.replace('ß', '[ßẞ]')}{after}"


def nfkc_text(value: str) -> str:
    return unicodedata.normalize("NFKC", value)


#: Characters that NFKC leaves alone, whatever stands beside them: ASCII, letters of Europe that are one character, Greek and
#: Cyrillic ones, dashes, quotes, kana, CJK and Hangul. No compatibility forms, and nothing that combines.
NFKC_STABLE = (
    r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03A1\u03A3-\u03CE\u0400-\u0481\u048A-\u052F"
    r"\u2010\u2012-\u2015\u2018-\u2023\u2039\u203A\u20AC\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"
)


#: A character that NFKC may change. Most characters are ASCII, which one comparison tells; the long class is tried on others only.
NFKC_CHANGES = rf"[^\x00-\x7F](?<=[^{NFKC_STABLE}])"


def nfkc(text: Column) -> Column:
    """NFKC form; texts that it surely leaves alone do not leave the JVM."""
    apply = F.pandas_udf(lambda s: s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x)), T.StringType())
    may_change = text.rlike(NFKC_CHANGES)
    return F.when(may_change, apply(F.when(may_change, text))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at its edges."""
    space = r"[\s\x1C-\x1F\x85\p{Z}]+"
    return F.regexp_replace(text, f"^{space}|{space}$", "")


def casefold(text: Column) -> Column:
    """Full case folding; ASCII in the JVM."""

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else x.casefold())

    apply = F.pandas_udf(fold, T.StringType())
    return F.when(text.rlike(r"[^\x00-\x7F]"), apply(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(F.lower(text))


def word_tokens(text: Column) -> Column:
    """Distinct words of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"{W}+"), F.lit(0)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _begins_small(token: Column) -> Column:
    """Begins with one of a to z: a comparison of bytes, which spares most tokens a pattern."""
    return (token >= "a") & (token < "{")


def is_punctuation(token: Column) -> Column:
    return ~_begins_small(token) & token.rlike(r"^\p{P}+$")


def is_footnote_ref(token: Column) -> Column:
    return token.rlike(r"^[\p{Nd}†‡§¶*]+$")


def strip_possessive(token: Column) -> Column:
    return F.when(token.endswith("'s") | token.endswith("’s"), F.left(token, F.length(token) - 2)).otherwise(token)


def is_all_caps(token: Column) -> Column:
    return token.rlike(r"^\p{L}{2,}$") & (token == F.upper(token))


def is_roman(token: Column) -> Column:
    return token.rlike("^[IVXLCDM]{1,8}$")


def is_number_like(token: Column) -> Column:
    return token.rlike(r"\p{Nd}") & ((F.length(token) <= 4) | token.rlike(r"^\p{Nd}+$"))


def is_capitalised(token: Column) -> Column:
    return ~_begins_small(token) & token.rlike(r"^\p{Lu}")


def clean_name(name: Column) -> Column:
    """Without white space, ASCII punctuation and curly quotes at its edges."""
    return F.regexp_replace(name, "^[\\s!-/:-@\\[-`{-~‘’“”]+|[\\s!-/:-@\\[-`{-~‘’“”]+$", "")


def upper_first(term: Column) -> Column:
    return F.concat(F.upper(F.substring(term, 1, 1)), F.substring(term, 2, 1 << 30))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches, in code points; a null text has none.

    The text is split at the matches; the lengths of the pieces and of the matches between them give the places. They are
    added up in blocks of about as many as there are blocks, so that a text full of matches is not copied for each of
    them. Texts without a match are not split.
    """
    kind = "array<struct<start: int, end: int>>"
    none = F.array().cast(kind)
    gaps, lengths = F.transform(F.split(text, pattern, -1), F.length), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(lengths)).alias("gap"), lengths.alias("length"))

    def cut(of: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(of))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(of), width), lambda i: F.slice(of, i, width))

    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + pair["length"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("spans"))

    def add_block(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("spans")), add)
        # By way of an array of one, so that the block is added up once.
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["spans"], r["spans"]).alias("spans")))[0]

    once = F.transform(F.array(pairs), cut)[0]
    folded = F.aggregate(once, F.struct(F.lit(0).alias("at"), none.alias("spans")), add_block)["spans"]
    return F.when(text.rlike(pattern), folded).otherwise(none)
