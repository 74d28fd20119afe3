"""Golden cases of the name index."""

import pytest

from pyspark.sql import functions as F

from folioscope.operators import consolidate, index, merge, names

CASES = [
    ("We met John Smith in Dublin. Smith left.", ["John Smith", "Dublin"]), ("He saw Dr John Smith there.", ["John Smith"]), ("London is big. Paris too.", []),
    ("Dr Hall spoke.", ["Hall"]), ("He read The Guardian daily.", ["Guardian"]), ("They saw John The Great today.", ["John The Great"]),
    ("It ended.75 Once upon Avon came Bob.", ["Avon", "Bob"]), ("It ended. XIV Once came Bob.", ["Bob"]), ("see BBC News and NATO now", ["News"]),
    ("see Chapter Hall then", ["Hall"]), ("cost. $ Dublin won", ["Dublin"]), ("we saw Jean-Paul O’Neill’s house", ["Jean-Paul O’Neill"]), ("", []),
]
# Text in asterisks is italic; after a caret, superscript.
STYLED = [
    ("he saw *The Sound of Music* twice", ["Sound of Music"]), ("he heard Adam Gorb's *Absinthe* live", ["Adam Gorb", "Absinthe"]),
    ("he heard Adam Gorb's *The Planets* live", ["Adam Gorb", "The Planets"]), ("he read *War and* more", ["War and"]), ("we saw John^75^ Smith there", ["John", "Smith"]),
]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["page_idx"], r["at"])):
        out.setdefault(r["page_idx"], []).append(r["name"])
    return out


def test_discovery(spark):
    pages = spark.createDataFrame([("b", k, str(k), x) for k, (x, _) in enumerate(CASES)], "book_id string, page_idx int, page_label string, text string")
    got = found(names.discover(names.plain_tokens(pages)))
    assert [got.get(k, []) for k in range(len(CASES))] == [w for _, w in CASES]


def test_discovery_in_styled_text(spark):
    rows = []
    for k, (text, _) in enumerate(STYLED):
        spans = [(x, 2 if n % 2 else 0) for n, x in enumerate(text.split("*"))] if "*" in text else [(x, 1 if n % 2 else 0) for n, x in enumerate(text.split("^"))]
        rows.append(("b", k, str(k), spans))
    pages = spark.createDataFrame(rows, "book_id string, page_idx int, page_label string, spans array<struct<text: string, flags: int>>")
    got = found(names.discover(names.span_tokens(pages)))
    assert [got.get(k, []) for k in range(len(STYLED))] == [w for _, w in STYLED]


def test_excluded_words(spark):
    texts = ["the Dublin International Piano Competition began", "the Piano Trio and Piano"]
    pages = spark.createDataFrame([("b", k, str(k), x) for k, x in enumerate(texts)], "book_id string, page_idx int, page_label string, text string")
    assert found(names.discover(names.plain_tokens(pages), frozenset({"piano"}))) == {0: ["Dublin International Piano Competition"], 1: ["Trio"]}


@pytest.mark.parametrize("text,wanted", [("John Smith met Smith", ["John Smith", "Smith", "Smith"]), ("john smith", []), ("JOHN SMITH", ["John Smith", "Smith"]), ("John, Smith", ["Smith"]), ("John Dr Smith", ["Smith"]), ("John $ Smith's", ["Smith"])])
def test_location(spark, text, wanted):
    pages = spark.createDataFrame([("b", 0, "1", text)], "book_id string, page_idx int, page_label string, text string")
    vocab = spark.createDataFrame([("b", "John Smith"), ("b", "Smith")], "book_id string, name string")
    assert found(names.locate(names.plain_tokens(pages), vocab)).get(0, []) == wanted


def occ(spark, rows):
    return spark.createDataFrame([("b", term, p, str(p + 1)) for term, ps in rows for p in ps], "book_id string, term string, page_idx int, page_label string")


def pages_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["term"], set()).add(r["page_idx"])
    return out


def test_ranges_suppression_and_merges(spark):
    got = index.formatted(occ(spark, [("x", [0, 4, 5, 6, 9, 10])])).first()
    assert got["pages"] == "1, 5-7, 10-11"
    assert pages_of(index.suppress_covered(occ(spark, [("Hall", [10, 12]), ("Hall, Baronial", [10])]))) == {"Hall": {12}, "Hall, Baronial": {10}}
    abc = occ(spark, [("a", [1]), ("b", [2]), ("c", [3])])
    assert pages_of(merge.apply_merges(abc, [("a", "b"), ("b", "c")])) == {"c": {1, 2, 3}}
    assert pages_of(merge.apply_merges(abc, [("b", "c"), ("a", "b")])) == {"a": {1}, "c": {2, 3}}
    before = occ(spark, [("a", [1, 2]), ("b", [2, 3])])
    after, original, added = merge.merge_with_undo(before, "a", "b")
    assert pages_of(after) == {"b": {1, 2, 3}} and pages_of(merge.undo(after, original, added, "b")) == {"a": {1, 2}, "b": {2, 3}}


def test_suggestions(spark):
    got = merge.merge_suggestions(index.nested(occ(spark, [("Smith", [1]), ("John Smith", [1]), ("Smith, John", [2])]))).collect()
    assert [(r["source"], [c["entry"] for c in r["containers"]], r["target"]) for r in got] == [("Smith", ["Smith, John", "John Smith"], "Smith, John")]


def test_groups_of_forms(spark):
    rows = [
        ("John Smith", [1, 2]), ("Smith", [2, 3]), ("john", [4]), ("Cambridge Professor", [1]), ("Cambridge", [1, 5]), ("Dr Jenny Macmillan Lodge", [7]), ("Jenny Macmillan", [7, 8]), ("Macmillan", [9]), ("Anna Smith", [6]), (" ", [1]),
    ]
    terms = occ(spark, rows)
    groups = consolidate.name_groups(terms)
    assert {r["term"]: r["longest_form"] for r in groups.collect() if r["term"] != r["longest_form"]} == {
        "Smith": "Anna Smith", "john": "John Smith", "Jenny Macmillan": "Dr Jenny Macmillan Lodge", "Macmillan": "Dr Jenny Macmillan Lodge",
    }
    got = pages_of(consolidate.group_pages(terms, groups))
    assert got["Smith, John"] == {1, 2} and got["Smith"] == {2, 3} and got["Jenny Macmillan"] == {8} and got["Cambridge"] == {1, 5} and got["Cambridge Professor"] == {1}
    assert consolidate.group_pages(terms.limit(0), groups).count() == 0 and consolidate.name_groups(terms.limit(0)).count() == 0


def test_lines_in_capitals_and_last_characters(spark):
    line = lambda *texts: ([0.0, 0.0, 1.0, 1.0], [(x, 0) for x in texts])
    blocks = [(0, [line("THE ", "END 12"), line("The END"), line("12")]), (1, [line("NO TEXT")]), (0, [line("ÄRGER. "), line("  ", None)])]
    kind = "book_id string, page_idx int, page_label string, blocks array<struct<type: int, lines: array<struct<bbox: array<double>, spans: array<struct<text: string, flags: int>>>>>>"
    pages = spark.createDataFrame([("b", 0, "1", blocks)], kind)
    assert [r["line"] for r in names.all_caps_lines(pages).collect()] == [0, 3]
    assert pages.select(F.transform("blocks", names.last_text_char).alias("c")).first()["c"] == ["2", "T", "."]


def test_small_words_in_a_row(spark):
    """Only the first of them is folded; titles and connectors in italics are."""
    texts = ["we saw that John dr Smith and then the old Bob went on and on. It was so", "sie sah über den Alten Markt hin"]
    pages = spark.createDataFrame([("b", k, str(k), x) for k, x in enumerate(texts)], "book_id string, page_idx int, page_label string, text string")
    tokens = names.plain_tokens(pages)
    short = {r["page_idx"]: [k["text"] for k in r["tokens"]] for r in names._without_runs(tokens).collect()}
    assert short == {0: ["we", "John", "dr", "Smith", "and", "Bob", "went", ".", "It", "was"], 1: ["sie", "Alten", "Markt", "hin"]}
    assert found(names.discover(tokens)) == {0: ["John Smith", "Bob"], 1: ["Alten Markt"]}


def test_lengths_are_looked_for_by_two_words(spark, monkeypatch):
    """Names of many lengths that begin alike: none is tried where the second word is another."""
    kept = {}
    store = names.stored
    monkeypatch.setattr(names, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    vocab = spark.createDataFrame([("b", "De " + " ".join(f"W{k}x{j}" for j in range(k))) for k in range(1, 40)] + [("b", "De"), ("b", "W3x1 W3x2")], "book_id string, name string")
    text = "De De W3x0 W3x1 W3x2 and De " + "Other De " * 30 + "De W9x0 W9x1"
    pages = spark.createDataFrame([("b", 0, "1", text)], "book_id string, page_idx int, page_label string, text string")
    got = found(names.locate(names.plain_tokens(pages), vocab))[0]
    assert got == ["De", "De W3x0 W3x1 W3x2", "W3x1 W3x2", *["De"] * 32]
    assert kept["name-starts"].selectExpr("sum(size(lengths))").first()[0] == 2


def test_unstyled_tokens_are_read_as_texts(spark):
    """Pages of texts give what the same pages of tokens do, without a token being made."""
    texts = ["We met John Smith's Aunt in New York. IV Smith, 75 Avon and the NATO", "", None, "; Dr Ödland Straße ran. § Ada King x9 Ada King Lovelace of Kent! ΣΑΣ A4 Kent's"]
    pages = spark.createDataFrame([("b", k, str(k + 1), x) for k, x in enumerate(texts)], "book_id string, page_idx int, page_label string, text string")
    tokens = names.plain_tokens(pages)
    for options in ({}, {"discovery": False}, {"excludes": frozenset({"Avon", "king"})}):
        of_texts, of_tokens = names.discover(tokens.select("book_id", "page_idx", "texts"), **options), names.discover(tokens.drop("texts"), **options)
        assert found(of_texts) == found(of_tokens) != {}
    vocab = names.vocabulary(names.discover(tokens)).unionByName(spark.createDataFrame([("b", "Ada King"), ("b", "Smith Aunt"), ("b", "King Lovelace of Kent"), ("b", "Ada King Lovelace of")], "book_id string, name string"))
    of_texts, of_tokens = names.locate(tokens.drop("tokens"), vocab), names.locate(tokens.drop("texts"), vocab)
    assert found(of_texts) == found(of_tokens) and {"Ödland Straße", "Ada King", "Ada King Lovelace of"} <= set(found(of_texts)[3])
    assert "lambdafunction" not in names.discover(tokens)._jdf.queryExecution().optimizedPlan().toString()


def test_flags_that_are_not_known(spark):
    """A flag that is null neither begins another name nor lets a connector go on, and its word does not begin a sentence."""
    rows = [[("He", False), ("Ada", None), ("King", True), ("and", True), ("Bo", None)], [("Ada", None), ("saw", False)], [("x", False), ("War", True), ("and", True), ("Peace", True), ("Bo", False)]]
    kind = "book_id string, page_idx int, page_label string, tokens array<struct<text: string, bold: boolean, italic: boolean, superscript: boolean>>"
    pages = spark.createDataFrame([("b", k, "", [(w, False, i, None) for w, i in r]) for k, r in enumerate(rows)], kind)
    assert found(names.discover(pages)) == {0: ["Ada King", "Bo"], 1: ["Ada"], 2: ["War and Peace", "Bo"]}


def test_texts_are_cut_into_words_once(spark):
    """Both passes of the index, and the union with keywords after them, read pages' words from where they were stored."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    kind = "book_id string, page_idx int, page_label string, text string"
    pages = spark.createDataFrame([("b", 0, "1", "we met Ada King and saw Ada King of Kent"), ("b", 1, "2", "by King, Ada King")], kind).mapInArrow(count, kind)
    occ = index.suppress_covered(index.unite(occ_of_none(spark), names.name_index(names.plain_tokens(pages))))
    assert pages_of(occ) == {"King, Ada": {0, 1}, "Kent": {0}}
    assert seen.value == 2


def occ_of_none(spark):
    return occ(spark, [("none", [])])


def test_runs_end_at_the_next_mark():
    """Of the lengths that are looked for, only those before a mark leave the page."""
    import pyarrow as pa

    texts = ["De", "W1's", "W2", ",", "De", "W1", None, "De", "W1", "W2"]
    plan = [{"at": 0, "lengths": [3, 4, 900]}, {"at": 4, "lengths": [3]}, {"at": 7, "lengths": [4, 3]}]
    plans = pa.array([plan, []], pa.list_(pa.struct([("at", pa.int32()), ("lengths", pa.list_(pa.int32()))])))
    pages = pa.RecordBatch.from_arrays([pa.array(["b", "b"]), pa.array([5, 6], pa.int32()), pa.array(["6", "7"]), pa.array([texts, []], pa.list_(pa.string())), plans], names=["book_id", "page_idx", "page_label", "texts", "plan"])
    got = [tuple(r.values()) for part in names._whole_runs(iter([pages, pages.slice(1)])) for r in part.to_pylist()]
    assert got == [("b", 5, "6", 0, 3, "De W1 W2"), ("b", 5, "6", 7, 3, "De W1 W2")]
