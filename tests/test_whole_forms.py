"""Queries on name forms over every occurrence."""

from folioscope.plans.queries import ORACLE_SQL, QUERIES, form_occ

SF = "/root/testdata/sf0.001"


def test_every_occurrence_is_there(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    wanted = {(t, k) for k, *texts in parts for x in texts for t in (x, " ".join(x.split(" ")[:2]), *x.split(" "))}
    assert {(r["term"], r["page_idx"]) for r in form_occ(spark, SF, whole=True).collect()} == wanted
    lead = {(r["longest_form"], r["page_idx"]) for r in QUERIES["name_group_pages_whole"](spark, SF).collect()}
    forms = {r["term"]: r["longest_form"] for r in QUERIES["name_groups_whole"](spark, SF).collect()}
    assert lead == {(forms[t], k) for t, k in wanted}
    assert "% 7" not in ORACLE_SQL["name_groups_whole"] + ORACLE_SQL["name_group_pages_whole"]


def test_pages_of_forms_apart_from_their_longest(spark):
    from folioscope.operators import consolidate

    rows = [("b", t, k, str(k + 1)) for t, k in (("John Smith", 1), ("Smith", 1), ("Smith", 2), ("Smith", 7), ("John Smith", 9))]
    occ = spark.createDataFrame(rows, "book_id string, term string, page_idx int, page_label string")
    got = consolidate.group_pages(occ, consolidate.name_groups(occ.select("book_id", "term"))).collect()
    assert sorted((r["term"], r["page_idx"]) for r in got) == [("Smith", 2), ("Smith", 7), ("Smith, John", 1), ("Smith, John", 9)]


def test_occurrences_are_not_broadcast(spark):
    """By the size of a small file that much comes of, they would be."""
    from folioscope.operators import consolidate

    for most in (consolidate.MOST_SENT, 0):
        occ = form_occ(spark, SF, whole=True)
        groups = consolidate.name_groups(occ.select("book_id", "term"))
        old, consolidate.MOST_SENT = consolidate.MOST_SENT, most
        try:
            got = consolidate.group_pages(occ, groups)
        finally:
            consolidate.MOST_SENT = old
        plan = got._jdf.queryExecution().executedPlan().toString()
        sent = [x for x in plan.split("BroadcastExchange")[1:]]
        assert len(sent) == (1 if most else 0) and all("/groups-" in x.split("Scan parquet", 1)[1].split("\n", 1)[0] for x in sent)
        assert {(r["term"], r["page_idx"]) for r in got.collect()} == {(r["term"], r["page_idx"]) for r in QUERIES["name_group_pages_whole"](spark, SF).collect()}
