"""The positional index and long keyword lists against the forms that read all text."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import keywords, positions, search

PHRASES = ["the", "The end", " end", "end ", "d t", "aa", "a", "aba", "é", "É x", "end, The", "(x)", "\\E", "nd.\nThe", "  ", "zzz", "ß", "x  y", "İ", "\tx"]


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(7)
    words = ["the", "The", "end", "END,", "end.", "aaaa", "ababa", "é", "É", "(x)", "x", "y", "\\E", "ß", "ẞ", "İi", "ﬁn", "-", "'tis", "a-b", " ", "John", "Smith", "smith", "x" * 300]
    gaps = [" ", " ", " ", "  ", "\n", "\t", " \n", " ", "\x0b"]
    rows = [("b" + str(k % 3), k, "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(60)))) for k in range(120)]
    rows += [("b1", 500, None), ("b1", 501, ""), ("b1", 502, " \n "), ("b4", 1, " lead"), ("b4", 2, "aaaaaaa " * 50), ("b5", 1, "\U0001f600 the end \U0001f600")]
    return spark.createDataFrame(rows, "book_id string, page_idx int, text string").withColumn("page_label", F.lit("")).repartition(4)


@pytest.fixture(scope="module")
def index(texts):
    return positions.build_index(texts, part_bytes=2000)


@pytest.mark.parametrize("phrase", [p for p in PHRASES if p.strip()])
def test_phrases_as_by_scan(texts, index, phrase):
    got, wanted = positions.phrase_search(index, phrase), search.phrase_search(texts, phrase)
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_counts_have_every_book(texts, index):
    for phrase in ("the", "zzz"):
        assert sorted(map(tuple, positions.phrase_count(index, phrase).collect())) == sorted(map(tuple, search.phrase_count(texts, phrase).collect()))


def test_blank_phrase(index):
    with pytest.raises(ValueError):
        positions.phrase_search(index, " \n")


def test_only_the_words_parts_are_read(index):
    total = index.postings().select("part").distinct().count()
    wanted = index.dictionary().where("term in ('John', 'end.')")
    parts = {r["part"] for r in wanted.collect()}
    plan = index.named(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r[0] for r in index.named(wanted).select(F.input_file_name()).distinct().collect()}
    assert len(parts) < total and all(any(f"/part={p}/" in f for p in parts) for f in files)


def test_many_spellings_are_joined(texts, index, monkeypatch):
    wanted = sorted(map(tuple, search.phrase_search(texts, "e").collect()))
    monkeypatch.setattr(positions, "MOST_NAMED", 2)
    assert sorted(map(tuple, positions.phrase_search(index, "e").collect())) == wanted


def test_frequent_words_fill_several_files(spark, texts, monkeypatch):
    monkeypatch.setattr(positions, "FILE_ROWS", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tasks this small are put together
    try:
        index = positions.build_index(texts.unionByName(texts.withColumn("page_idx", F.col("page_idx") + 1000)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    again = texts.unionByName(texts.withColumn("page_idx", F.col("page_idx") + 1000))
    assert sorted(map(tuple, positions.phrase_search(index, "the end").collect())) == sorted(map(tuple, search.phrase_search(again, "the end").collect()))
    assert index.postings().where("term = 'the'").select(F.input_file_name()).distinct().count() > 1


def test_a_text_is_the_sum_of_its_postings(texts, index):
    rows = {}
    for r in sorted(index.postings().collect(), key=lambda r: (r["book_id"], r["page_idx"], r["at"])):
        rows.setdefault((r["book_id"], r["page_idx"]), []).append((r["before"] if r["at"] == 0 else "") + r["term"] + r["after"])
    for r in texts.collect():
        if (r["text"] or "").strip(" \t\n\x0b\f\r"):
            assert "".join(rows[r["book_id"], r["page_idx"]]) == r["text"]


def test_highlights_as_by_scan(spark, texts):
    terms = spark.createDataFrame(list(enumerate(["the end", "Smith, John", "é", "x", "fin", "x - y", "end", "- the", "a-b", ""])), "ord int, term string")
    index = positions.build_index(texts, normal=True, part_bytes=2000)
    got, wanted = positions.highlights(index, terms), search.highlights(texts, terms)
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_an_index_of_nothing(spark, texts):
    index = positions.build_index(texts.limit(0))
    assert positions.phrase_search(index, "the").count() == positions.phrase_count(index, "the").count() == 0


LIST = ["the", "The", "end", "the end", "end, The", "(x)", "x) y", ",", ". The", "C++", "é", "ß", "fin", "İi", "i", "a-b", "b", "-", "'tis", "tis", " John ", "", "  ", "John  Smith", "John Smith", " ", "smith", "ﬁn", "END,"]


@pytest.mark.parametrize("most", [1000, 5])
def test_long_lists_as_pattern_by_pattern(spark, texts, most):
    more = texts.unionByName(spark.createDataFrame([("b9", 1, "C++y and C++ is, C++", "iv"), ("b9", 2, "(x)y", "")], "book_id string, page_idx int, text string, page_label string"))
    listed = spark.createDataFrame(list(enumerate(LIST)), "ord int, word string")
    got = keywords.keyword_list_hits(more, listed, most=most)
    wanted = keywords.keyword_hits(more, LIST)
    pick = ["book_id", "term", "page_idx", "page_label"]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, wanted.select(*pick).collect()))


def test_a_hundred_thousand_keywords_take_one_scan(spark, texts):
    listed = spark.range(100_000).selectExpr("id as ord", "concat('word', id) as word").unionByName(spark.createDataFrame([(200_000, "the end")], "ord long, word string"))
    got = keywords.keyword_list_hits(texts, listed)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert got.select("term").distinct().collect()[0][0] == "the end"


def test_an_empty_list(spark, texts):
    assert keywords.keyword_list_hits(texts, spark.createDataFrame([], "ord int, word string")).count() == 0


def test_texts_are_cut_into_words_once(spark, texts, index, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), positions.word_postings

    def count(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    def counted(pages):
        rows = plain(pages)
        assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(positions, "word_postings", counted)
    built = positions.build_index(texts, part_bytes=2000)
    assert seen.value == built.postings().count() == index.postings().count()
