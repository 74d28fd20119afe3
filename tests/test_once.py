"""Texts are read once, and the characters that NFKC may change are found by a short test first."""

import re
import sys

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import index, keywords, merge, merge_log

KINDS = "book_id string, page_idx int, page_label string, text string"


def test_characters_that_may_change(spark):
    stable = re.compile(f"[{t.NFKC_STABLE}]")
    codes = [c for c in [*range(1, 0x3000), 0x4E00, 0xAC00, 0xFB01, 0xFF21, 0x1D400, 0x1F600, 0x2F800] if not 0xD800 <= c < 0xE000 and c <= sys.maxunicode]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, text string")
    got = {r["c"] for r in rows.where(F.col("text").rlike(t.NFKC_CHANGES)).select("c").collect()}
    assert got == {c for c in codes if not stable.match(chr(c))}
    assert t.NFKC_CHANGES.startswith(r"[^\x00-\x7F]")  # the long class is not tried on each character


def test_sharp_s_alone(spark):
    pages = spark.createDataFrame([("b", 0, "1", "a ẞ"), ("b", 1, "2", "a ß."), ("b", 2, "3", "aß"), ("b", 3, "4", "GROẞ")], KINDS)
    got = {(r["term"], r["page_idx"]) for r in keywords.keyword_hits(pages, ["ß", "groß"]).collect()}
    assert got == {("ß", 0), ("ß", 1), ("groß", 3)}


LOG = [(1, "merge", "a", "b", None), (2, "merge", "b", "c", None), (3, "undo", None, None, 1)]


@pytest.mark.parametrize("work", ["changes", "state", "merges", "undo", "capitalised", "suppressed"])
def test_occurrences_are_computed_once(spark, work):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    rows = [("b", term, p, str(p + 1)) for term, ps in (("a", (1, 2)), ("b", (2, 3)), ("c", (5,))) for p in ps]
    kind = "book_id string, term string, page_idx int, page_label string"
    occ = spark.createDataFrame(rows, kind).mapInArrow(count, kind)
    log = spark.createDataFrame(LOG, merge_log.SCHEMA)
    if work == "changes":
        got = {(r["term"], r["page_idx"], r["change"]) for r in merge_log.changes(occ, log, 2, 3).collect()}
        assert got == {("a", 1, "added"), ("a", 2, "added"), ("c", 1, "gone")}
    elif work == "state":
        assert {(r["term"], r["page_idx"]) for r in merge_log.state(occ, log, 2).collect()} == {("c", p) for p in (1, 2, 3, 5)}
    elif work == "merges":
        assert {(r["term"], r["page_idx"]) for r in merge.apply_merges(occ, [("a", "b")]).collect()} == {("b", 1), ("b", 2), ("b", 3), ("c", 5)}
    elif work == "undo":
        after, original, added = merge.merge_with_undo(occ, "a", "b")
        assert sorted((r["term"], r["page_idx"]) for r in merge.undo(after, original, added, "b").collect()) == sorted((r[1], r[2]) for r in rows)
    elif work == "suppressed":
        assert index.suppress_covered(occ).count() == len(rows)
    else:
        assert {r["display_term"]: r["pages"] for r in index.formatted(occ, capitalize=True).collect()} == {"A": "2-3", "B": "3-4", "C": "6"}
    assert seen.value == len(rows)


def test_passes_do_not_grow_with_the_words_of_a_list(spark):
    pages = spark.createDataFrame([("b", 0, "1", "Word7 and word12, word12"), ("b", 1, "2", "word1 WORD30.")], KINDS)
    listed = spark.range(40).selectExpr("id as ord", "concat('word', id) as word").unionByName(spark.createDataFrame([(100, "word7 and")], "ord long, word string"))
    got = keywords.keyword_list_hits(pages, listed, most=4)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # pages' words, and the keyword of two
    assert sorted((r["page_idx"], r["term"]) for r in got.collect()) == [(0, "word12"), (0, "word7"), (0, "word7 and"), (1, "word1"), (1, "word30")]


def test_tokens_of_one_file_go_to_many_tasks(spark, monkeypatch):
    from folioscope.plans import index_queries

    class Seen(Exception):
        pass

    def stop(tokens, *_):
        raise Seen(tokens.select(F.input_file_name()).distinct().count())

    monkeypatch.setattr(index_queries.recognise, "labelled", stop)
    with pytest.raises(Seen) as seen:
        index_queries.recognised(spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] > 8


def test_stop_words_are_looked_up_and_words_found_once(spark):
    from folioscope.operators import pairs

    pages = spark.createDataFrame([("b", 0, "1", "red house monday red house x"), ("b", 1, "2", "red"), ("b", 2, "3", None)], KINDS)
    found = pairs.word_pairs(pages, frozenset({"Green"}))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "array_contains" not in plan
    assert {tuple(r) for r in found.collect()} == {("red", "house", 2)}


def test_runs_are_joined_by_blocks(spark):
    rows = [("b", t, p, str(p + 1)) for t, ps in (("a", (0, 1, 3, 4, 5, 9, 11, 12)), ("c", (7, 8))) for p in ps]
    occ = spark.createDataFrame(rows, "book_id string, term string, page_idx int, page_label string")
    seen = []
    label = F.concat_ws("-", "first_label", "last_label")
    for block in (1, 4, 1 << 16):
        seen.append({r["term"]: r["pages"] for r in index.joined_runs(index.page_runs(occ), label, block).collect()})
    assert seen == [{"a": "1-2, 4-6, 10-10, 12-13", "c": "8-9"}] * 3
    assert {r["display_term"]: r["pages"] for r in index.formatted(occ).collect()} == {"a": "1-2, 4-6, 10, 12-13", "c": "8-9"}


def test_shared_pages_read_occurrences_once(spark):
    from folioscope.operators import reports

    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    rows = [("b", t, p, str(p + 1)) for t in ("red", "blue") for p in range(5)] + [("b", "green", 9, "10")]
    kind = "book_id string, term string, page_idx int, page_label string"
    occ = spark.createDataFrame(rows, kind).mapInArrow(count, kind)
    assert [tuple(r) for r in reports.shared_pages(occ).collect()] == [("b", "blue", "red", "100% overlap")]
    assert seen.value == len(rows)
