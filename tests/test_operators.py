"""Operators that no query covers, on inline cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from folioscope import lexicon
from folioscope.config import IndexConfig
from folioscope.functions import text as t
from folioscope.operators import index, keywords, merge, names, render, reports, search
from folioscope.sources import tables


def occ(spark, rows, book="b"):
    return spark.createDataFrame([(book, term, p, str(p + 1)) for term, ps in rows for p in ps], "book_id string, term string, page_idx int, page_label string")


def page(spark, *texts):
    return spark.createDataFrame([("b", k, str(k + 1), x) for k, x in enumerate(texts)], "book_id string, page_idx int, page_label string, text string")


def column(df, name):
    return sorted((r[name] for r in df.collect()), key=str)


def test_words_are_added_in_any_case_once(spark):
    words = spark.createDataFrame([("apple",)], "word string")
    more = spark.createDataFrame([(0, " Foo "), (1, "foo"), (2, "APPLE"), (3, "  "), (4, "bar")], "ord int, word string")
    assert column(keywords.add_if_absent(words, more), "word") == ["Foo", "apple", "bar"]
    assert column(keywords.add_if_absent(words, more.select("word")), "word") == ["Foo", "apple", "bar"]
    assert keywords.from_selection(' "word".,; ') == '"word'
    assert column(keywords.sort_and_dedup(more), "word") == ["APPLE", "Foo", "bar"]


def test_lists_are_read(spark, tmp_path):
    path = str(tmp_path / "list.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write(" one \n\n\ttwo \nthree\n")
    assert column(tables.word_list(spark, path), "word") == ["one", "three", "two"]
    assert tables.keyword_lines(spark, path) == [" one ", "", "\ttwo ", "three"]
    assert tables.split_excludes("a, b ,,c") == ["a", "b", "c"]
    known = spark.createDataFrame([("John", "person"), ("Rome", "place_thing"), ("x", "other")], "name string, type string")
    places = spark.createDataFrame([("Paris",)], "word string")
    assert sorted(map(tuple, tables.name_types(known, places).collect())) == [("john", "person"), ("paris", "place_thing")]
    assert sorted(map(tuple, tables.legacy_types(places).collect())) == [("paris", "place_thing")]
    assert names.with_defaults(frozenset({"Foo"})) == lexicon.STOPWORDS | {"foo"}


def test_settings():
    assert IndexConfig(page_offset=-3, index_from_offset=True).start_page == 3 and IndexConfig(page_offset=-3).start_page == 0
    with pytest.raises(ValueError):
        IndexConfig(page_strategy="other")
    with pytest.raises(ValueError):
        IndexConfig(thin=11)


def test_nfkc_of_pages(spark):
    texts = ["ﬁne ＡＢＣ", "ASCII only", "é ñ Ж 中 かな", "é here", "½ cup", None]
    got = page(spark, *texts).select("page_idx", t.nfkc(F.col("text")).alias("x")).collect()
    import unicodedata

    assert {r["page_idx"]: r["x"] for r in got} == {k: x and unicodedata.normalize("NFKC", x) for k, x in enumerate(texts)}
    hits = keywords.keyword_hits(page(spark, "ﬁne day", "Kıng ABC", "ＡＢＣ", "C++ is", "C++y", "New\nYork"), ["fine", "king", "abc", "C++", "New York"])
    assert sorted((r["term"], r["page_idx"]) for r in hits.collect()) == [("C++", 4), ("abc", 1), ("abc", 2), ("fine", 0), ("king", 1)]


def test_capitalised_terms_that_meet(spark):
    both = occ(spark, [("apple", [1]), ("Apple", [2])])
    assert [tuple(r) for r in index.formatted(both, capitalize=True).collect()] == [("b", "Apple", "3")]
    assert [tuple(r) for r in index.formatted(occ(spark, [("apple", [4]), ("Apple", [2])]), capitalize=True).collect()] == [("b", "Apple", "5")]
    same = occ(spark, [("apple", [1]), ("Apple", [1, 2])]).withColumn("ord", F.when(F.col("term") == "apple", 5).otherwise(2))
    assert [tuple(r) for r in index.formatted(same, capitalize=True).collect()] == [("b", "Apple", "2")]
    assert [tuple(r) for r in index.formatted(both, capitalize=True, merge_on_collision=True).collect()] == [("b", "Apple", "2-3")]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 16])
def test_runs_are_the_same_in_blocks(spark, block):
    pages = [0, 1, 2, 4, 5, 6, 7, 8, 13, 20, 21]
    got = index.page_runs(occ(spark, [("x", pages), ("y", [3])]), block).select("term", "first_idx", "last_idx", "first_label", "last_label").collect()
    assert sorted(map(tuple, got)) == [("x", 0, 2, "1", "3"), ("x", 4, 8, "5", "9"), ("x", 13, 13, "14", "14"), ("x", 20, 21, "21", "22"), ("y", 3, 3, "4", "4")]
    assert index.page_runs(occ(spark, [("x", [1])]).limit(0), block).count() == 0


def test_lookup_and_order(spark):
    lines = index.formatted(occ(spark, [("Hall", [1]), ("Town Hall", [2]), ("hallway", [3])]))
    assert index.lookup(lines, "hall").first()["display_term"] == "Hall"
    assert index.lookup(lines, "town").first()["display_term"] == "Town Hall"
    assert index.lookup(lines, "way").first()["display_term"] == "hallway" and index.lookup(lines, "zzz").count() == 0
    assert [r["display_term"] for r in index.ordered(lines).collect()] == ["Hall", "hallway", "Town Hall"]
    assert index.goto(page(spark, "a", "b"), 2).first()["text"] == "b" and index.goto(page(spark, "a"), 2).count() == 0
    assert index.parse_link("#12|a|b") == (12, "a|b")


def test_lines_are_written(spark, tmp_path):
    lines = render.active_lines(occ(spark, [("b", [1, 2]), ("A", [0])]))
    for kind, first in (("text", "Index (2 entries)"), ("markdown", "# Index (2 entries)"), ("html", "<html><body><h1>Index (2 entries)</h1>"), ("active", "<body><h1>Active Index (2 entries)</h1>")):
        render.write_lines(lines, str(tmp_path / kind), kind)
        got = [r[0] for r in spark.read.text(str(tmp_path / kind)).collect() if r[0]]
        assert first in got[0] and '<a href="#1|b">2</a>-<a href="#2|b">3</a>' in "".join(got)
        assert ("</body></html>" in got) == (kind in ("html", "active"))
    assert render.escaped(F.lit("a")) is not None


def test_index_goes_to_json_and_back(spark, tmp_path):
    own = occ(spark, [("Zoë \"x\"\n", [3, 1]), ("apple", [0]), ("\U0001f600", [2])]).unionByName(occ(spark, [("apple", [7])], "c"))
    path = str(tmp_path / "index")
    render.write_json(index.nested(own), path)
    back = tables.read_index(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, own.collect()))
    whole = {"apple": [[0, "1"]], "Zoë \"x\"\n": [[1, "2"], [3, "4"]], "\U0001f600": [[2, "3"]]}
    lines = [r["line"] for r in render.json_lines(index.nested(own.where("book_id = 'b'"))).collect()]
    assert sorted(lines) == sorted(x.rstrip(",") for x in [json.dumps({k: v}, indent=2)[2:-2] for k, v in whole.items()])
    with open(tmp_path / "one.json", "w", encoding="utf-8") as f:
        json.dump(whole, f, indent=2)
    assert sorted(map(tuple, tables.read_index(spark, str(tmp_path / "one.json"), "b").collect())) == sorted(map(tuple, own.where("book_id = 'b'").collect()))


def test_merges_of_several_books_and_decisions(spark):
    own = occ(spark, [("a", [1]), ("b", [2]), ("c", [3])]).unionByName(occ(spark, [("a", [1]), ("c", [5])], "d"))
    got = sorted((r["book_id"], r["term"], r["page_idx"]) for r in merge.apply_merges(own, [("a", "b"), ("b", "c")]).collect())
    assert got == [("b", "c", 1), ("b", "c", 2), ("b", "c", 3), ("d", "a", 1), ("d", "c", 5)]
    assert merge.apply_merges(own, []).count() == 5
    suggestions = merge.merge_suggestions(occ(spark, [("Smith", [1]), ("John Smith", [1, 2]), ("Hall", [4]), ("Town Hall", [5])]))
    decisions = spark.createDataFrame([("Smith", "separate", "John Smith", 0), ("Jon", "merged", "John Smith", 3), ("Old", "separate", "x", 0)], "source string, decision string, target string, n_pages int")
    assert column(merge.pending(suggestions, decisions), "source") == ["Hall"]
    rows = merge.decided(suggestions, decisions, occ(spark, [("Smith", [1]), ("John Smith", [1, 2])])).collect()
    assert sorted((r["source"], r["decision"], r["source_pages"], r["containers"][0]["entry"], r["containers"][0]["pages"], r["target_pages"]) for r in rows) == [("Jon", "merged", 3, "John Smith", 2, 2), ("Smith", "separate", 1, "John Smith", 2, 2)]
    assert sorted(map(tuple, merge.keep_separate(decisions, "Jon", "y").collect()))[0] == ("Jon", "separate", "y")


def test_terms_without_words_share_no_pages(spark):
    own = occ(spark, [("!!", [1, 2]), ("foo", [1, 2]), ("bar", [1, 2, 3, 4, 5]), ("baz", [1, 2, 3, 4, 5, 6]), ("qux", [1, 2, 3, 4, 5, 6, 7]), ("bar baz", [1, 2, 3, 4, 5])])
    got = {(r["a"], r["b"]): r["note"] for r in reports.shared_pages(own).collect()}
    assert got == {("bar", "baz"): "83% overlap", ("baz", "qux"): "85% overlap"}


def test_findings_and_sections(spark):
    own = occ(spark, [("Color", [1]), ("Colour", [2]), ("BBC", [1]), ("British Broadcasting Corporation", [3]), ("new york", [5]), ("New York", [6])]).unionByName(occ(spark, [("x", [1])], "small"))
    none = spark.createDataFrame([(0, "color"), (1, "absent")], "ord int, word string")
    by = {}
    for report, book, key, terms, _ in reports.findings(own, none).collect():
        by.setdefault(report, []).append((book, terms))
        assert key == terms[0]
    assert by["similar_terms"] == [("b", ["Color", "Colour"])] and by["acronym_pairs"] == [("b", ["BBC", "British Broadcasting Corporation"])]
    assert by["capitalization_variants"] == [("b", ["New York", "new york"])] and by["unused_include_terms"] == [(None, ["absent"])]
    assert len(by["thin_entries"]) == 7 and "dense_entries" not in by
    assert sorted(r["html"] for r in render.finding_lines(reports.findings(own, none, reports=("acronym_pairs",))).collect()) == ["<p>BBC; British Broadcasting Corporation</p>"]
    over = {(r["report_id"], r["book_id"]) for r in reports.sections(own, most_similar=5, most_shared=100).where("not_run").collect()}
    assert over == {("similar_terms", "b")}
    assert reports.sections(own, ("thin_entries",)).where("not_run").count() == 16 and reports.sections(own.limit(0)).count() == 0
    got = {r["report_id"]: (r["findings"], r["not_run"]) for r in reports.summary(own, none, most_similar=5).collect()}
    assert got["similar_terms"] == (0, 1) and got["thin_entries"] == (7, 0) and len(got) == 9
    links = render.report_links(index.nested(spark.createDataFrame([("b", "x", 3, "4"), ("b", "y", 3, "iv")], "book_id string, term string, page_idx int, page_label string")))
    assert sorted((r["links"], r["more"]) for r in links.collect()) == [("4", 0), ("iv (PDF p.4)", 0)]


def test_highlights(spark):
    text = "The Great – Hall, (hall) hall Smith, John's john smith Great-Hall ﬁne ﬁne."
    words = text.split()
    got = lambda *terms: {(r["at"], r["term"]) for r in search.highlights(page(spark, text), spark.createDataFrame(list(enumerate(terms)), "ord int, term string")).collect()}
    assert got("hall") == {(3, "hall"), (4, "hall"), (5, "hall")}
    assert got("Hall") == {(3, "Hall")}
    assert got("Great Hall") == set()  # a dash of its own stands between
    assert got("Smith, John") == set() and got("john smith") == {(8, "john smith"), (9, "john smith")}
    assert got("smith, john") == {(8, "smith, john"), (9, "smith, john")}
    assert got("fine") == {(len(words) - 2, "fine"), (len(words) - 1, "fine")}
    assert got("hall", "HALL hall") == {(3, "HALL hall"), (4, "HALL hall"), (5, "hall")}
    assert got("john", "john smith") == {(8, "john smith"), (9, "john smith")} and got() == set()


def test_search_from_a_page(spark):
    found = search.phrase_search(page(spark, "a cat", "none", "cat and Cat"), "cat")
    assert [tuple(r) for r in search.first_hit(found, 1).collect()] == [("b", 2, 0, 0, 1, 3)]
    assert [tuple(r) for r in search.first_hit(found, 3).collect()] == [("b", 0, 0, 2, 0, 3)]
    assert search.next_hit(3, 2) == 0 and search.next_hit(3, 0, -1) == 2
    assert search.phrase_count(page(spark, "a.b aXb", None), "a.b").first()["matches"] == 1


def test_clicks_on_a_cloud():
    assert search.click("all", "Word,", ["word", "x"], []) == (["x"], []) and search.click("all", "new", ["x"], []) == (["x", "new"], [])
    assert search.click("not_in_index", "New.", ["new"], []) == (["new"], []) and search.click("not_in_index", "a", ["b"], ["c"]) == (["b", "a"], ["c"])
    assert search.click("in_index", "Foo!", ["x"], ["foo"]) == (["x"], ["foo"]) and search.click("in_index", "bar", ["x"], ["foo"]) == (["x"], ["foo", "bar"])


def test_recogniser_votes_and_marks(spark):
    pages = page(spark, "He met Anna Berg and later Anna Berg in Oslo Fjord there.")
    tokens = names.plain_tokens(pages)
    assert column(names.name_index(tokens), "term") == ["Berg, Anna", "Fjord, Oslo"]
    votes = spark.createDataFrame([("Oslo Fjord", "place_thing")] * 3 + [("Oslo Fjord", "person")] * 2, "name string, type string")
    assert column(names.name_index(tokens, votes=votes), "term") == ["Berg, Anna", "Oslo Fjord"]
    types = names.marked(spark.createDataFrame([("anna berg", "person")], "name string, type string"), "Berg, Anna", "place_thing")
    assert [tuple(r) for r in types.collect()] == [("anna berg", "place_thing")] and names.marked(types, "Anna Berg", None).count() == 0
    assert column(names.name_index(tokens, overrides=types, votes=votes), "term") == ["Anna Berg", "Oslo Fjord"]
    assert column(names.name_index(tokens, frozenset({"anna berg"}), surname_first=False), "term") == ["Oslo Fjord"]


def test_layout_separators(spark):
    span = lambda *texts: [(x, 0) for x in texts]
    line = lambda left, right, *texts: ([left, 0.0, right, 1.0], span(*texts))
    kind = "book_id string, page_idx int, page_label string, blocks array<struct<type: int, lines: array<struct<bbox: array<double>, spans: array<struct<text: string, flags: int>>>>>>"
    blocks = [(0, [line(0.0, 100.0, "full"), line(0.0, 50.0, "short"), line(0.0, 95.0, "wide")]), (1, [line(0.0, 9.0, "image")]), (0, [line(0.0, 20.0, "next")]), (0, [line(0.0, 30.0, "last")])]
    pages = spark.createDataFrame([("b", 0, "1", blocks)], kind)
    assert [x["text"] for x in names.layout_tokens(pages).first()["tokens"]] == ["full", "short", ".", "wide", "next", ".", "last"]


def test_long_pages_are_linear(spark):
    took = {}
    for n in (1500, 6000):
        pages = page(spark, "he saw Anna Berg with Carl Dahl and " * n, "Anna Berg Carl Dahl " * 40)
        began = time.monotonic()
        found = names.discover(names.plain_tokens(pages))
        assert found.where("page_idx = 0").count() == 2 * n
        vocab = names.vocabulary(found)
        assert names.locate(names.plain_tokens(pages), vocab).where("page_idx = 0").count() == 2 * n
        assert search.phrase_search(pages, "anna").where("page_idx = 0").count() == n
        took[n] = time.monotonic() - began
    assert took[6000] < 10 * took[1500] + 10, took
