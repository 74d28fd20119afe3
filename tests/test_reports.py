"""Reports on indexes that are larger than the given ones."""

import pytest

from folioscope.operators import reports


def test_a_long_chain_is_one_cluster(spark):
    names = [f"t{k:03}" for k in range(120)]
    rows = [("b", x, y) for x, y in zip(names, names[1:])] + [("c", "t000", "z"), ("c", "y", "z")]
    pairs = spark.createDataFrame(rows, "book_id string, a string, b string")
    got = {(r["book_id"], r["term"]): r["cluster"] for r in reports.similar_clusters(pairs).collect()}
    assert got == {("b", x): "t000" for x in names} | {("c", x): "t000" for x in ("t000", "y", "z")}
    assert reports.similar_clusters(pairs.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="did not settle"):
        reports.similar_clusters(pairs, rounds=1)


def test_summary_of_a_large_book(spark):
    rows = [("b", f"{k * 7919:08x}{'abcdefgh'[k % 8] * 8}{k * 104729:08x}", k) for k in range(2100)]
    rows += [("b", "colour", 5000), ("b", "color", 5001), ("b", "apple", 6000), ("b", "zebrafish", 6000)]
    occ = spark.createDataFrame(rows, "book_id string, term string, page_idx int").selectExpr("*", "cast(page_idx as string) as page_label")
    none = spark.createDataFrame([], "word string")
    got = {r["report_id"]: r["findings"] for r in reports.summary(occ, none, reports=("similar_terms", "shared_page_sets")).collect()}
    assert got == {"similar_terms": 1, "shared_page_sets": 1}
