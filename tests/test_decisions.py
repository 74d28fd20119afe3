"""The merge log, word pairs and plurals on small tables, and hot keys of reports."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import merge, merge_log, pairs, reports

SCHEMA = "book_id string, term string, page_idx int, page_label string"


@pytest.fixture(scope="module")
def occ(spark):
    rows = [("x", "a", 1, "p1"), ("x", "b", 2, "p2"), ("x", "c", 3, "p3"), ("x", "b", 1, "p1"), ("x", "d", 9, "p9"), ("y", "a", 5, "5"), ("y", "c", 5, "5"), ("z", "q", 1, "1")]
    return spark.createDataFrame(rows, SCHEMA)


def state(occ, log, version=None):
    return sorted(map(tuple, merge_log.state(occ, log, version).collect()))


def rows(occ):
    return sorted(map(tuple, occ.collect()))


@pytest.fixture(scope="module")
def log(occ):
    log = merge_log.empty_log(occ)
    log = merge_log.added(log, "merge", "a", "b")
    log = merge_log.added(log, "merge", "b", "c")
    log = merge_log.added(log, "separate", "d", "c")
    log = merge_log.added(log, "undo", undoes=1)
    return merge_log.added(log, "merge", "d", "c").cache()


def test_every_version_can_be_had(occ, log):
    assert [r["version"] for r in log.orderBy("version").collect()] == [1, 2, 3, 4, 5]
    assert state(occ, log, 0) == rows(occ)
    assert state(occ, log, 1) == sorted([("x", "b", 1, "p1"), ("x", "b", 2, "p2"), ("x", "c", 3, "p3"), ("x", "d", 9, "p9"), ("y", "a", 5, "5"), ("y", "c", 5, "5"), ("z", "q", 1, "1")])
    assert state(occ, log, 2) == state(occ, log, 3) == sorted([("x", "c", 1, "p1"), ("x", "c", 2, "p2"), ("x", "c", 3, "p3"), ("x", "d", 9, "p9"), ("y", "a", 5, "5"), ("y", "c", 5, "5"), ("z", "q", 1, "1")])


def test_an_undo_in_the_middle_leaves_later_decisions(occ, log):
    after = state(occ, log, 4)
    assert ("x", "a", 1, "p1") in after and ("x", "c", 1, "p1") in after and ("x", "c", 2, "p2") in after
    assert state(occ, log) == sorted(r for r in after if r[1] != "d") + [] or ("x", "c", 9, "p9") in state(occ, log)
    assert all(r[1] != "d" for r in state(occ, log))


def test_states_are_those_of_applied_merges(occ, log):
    assert state(occ, log, 2) == rows(merge.apply_merges(occ, [("a", "b"), ("b", "c")]))
    assert state(occ, log, 4) == rows(merge.apply_merges(occ, [("b", "c")]))


def test_changes_between_versions(occ, log):
    got = sorted(map(tuple, merge_log.changes(occ, log, 3, 4).collect()))
    assert got == [("x", "a", 1, "added")]  # page 1 stays with c, by b
    assert merge_log.changes(occ, log, 2, 3).count() == 0
    assert sorted(map(tuple, merge_log.changes(occ, log, 4, 5).collect())) == [("x", "c", 9, "added"), ("x", "d", 9, "gone")]


@pytest.mark.parametrize("entry", [("undo", None, None, 9), ("undo", None, None, 4), ("undo", None, None, None), ("merge", "a", "a", None), ("merge", "a", None, None), ("rename", "a", "b", None)])
def test_entries_that_a_log_does_not_take(log, entry):
    with pytest.raises(ValueError):
        merge_log.added(log, *entry)


def test_an_undone_source_is_decided_by_its_earlier_entry(occ):
    log = merge_log.empty_log(occ)
    for entry in (("merge", "b", "c", None), ("merge", "b", "a", None), ("undo", None, None, 2)):
        log = merge_log.added(log, *entry)
    assert [(r["version"], r["target"]) for r in merge_log.standing(log).collect()] == [(1, "c")]
    assert [(r["version"], r["target"]) for r in merge_log.standing(log, 2).collect()] == [(2, "a")]


def test_candidates(spark):
    terms = [("x", t, k, "") for t, n in (("red ring", 1), ("Red Ring, small", 2), ("ring", 5), ("ringed", 9), ("hired ring", 1), ("blue", 3), ("a red ringlet", 1)) for k in range(n)]
    occ = spark.createDataFrame([*terms, ("y", "ring", 1, "")], SCHEMA)
    got = [(r["target"], r["pages"], r["common"], r["rank"]) for r in merge_log.candidates(occ, "red ring").orderBy("rank").collect()]
    assert got == [("Red Ring, small", 2, 2, 1), ("a red ringlet", 1, 1, 2), ("hired ring", 1, 1, 3), ("ring", 5, 1, 4)]
    assert merge_log.candidates(occ, "red ring", most=1).count() == 1 and merge_log.candidates(occ, "none").count() == 0


def test_pairs_score_as_the_formula_says(spark):
    texts = ["new york is new york"] * 6 + ["the old york road", "new road", None, "", "york"]
    pages = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["a"], r["b"]): r for r in pairs.collocated(pages, least_count=1, least_score=-1).collect()}
    words = [t.split() for t in texts if t]
    count = Counter((a, b) for w in words for a, b in zip(w, w[1:], strict=False))
    total = sum(count.values())
    for (a, b), row in got.items():
        n, na, nb = count[a, b], sum(c for (x, _), c in count.items() if x == a), sum(c for (_, y), c in count.items() if y == b)
        table = [(n, na * nb / total), (na - n, na * (total - nb) / total), (nb - n, (total - na) * nb / total), (total - na - nb + n, (total - na) * (total - nb) / total)]
        assert (row["n"], row["n_a"], row["n_b"]) == (n, na, nb) and n * total > na * nb
        assert math.isclose(row["score"], 2 * sum(o * math.log(o / e) for o, e in table if o), rel_tol=1e-9, abs_tol=1e-9)
    assert ("new", "york") in got and not any(r.a == "york" and r.b == "new" for r in got.values())
    assert pairs.collocated(pages, stop=frozenset({"NEW"}), least_score=-1).where("a = 'new' or b = 'new'").count() == 0
    assert pairs.collocated(pages.limit(0)).count() == 0


def test_plurals_go_to_their_singular(spark):
    counts = {"cat": 2, "cats": 3, "dogs": 4, "class": 1, "classes": 2, "city": 1, "cities": 5, "ties": 1, "tie": 1, "as": 2, "a": 9, "boss": 1, "bos": 1, "buses": 1, "bus": 2, "bu": 7, "series": 1, "news": 1, "new": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, count long")
    got = {r["word"]: (r["count"], r["forms"]) for r in pairs.folded_plurals(df).collect()}
    assert got == {"cat": (5, 2), "dogs": (4, 1), "class": (3, 2), "city": (6, 2), "tie": (2, 2), "as": (2, 1), "a": (9, 1), "boss": (1, 1), "bos": (1, 1), "bus": (3, 2), "bu": (7, 1), "series": (1, 1), "new": (2, 2)}
    assert sum(n for n, _ in got.values()) == sum(counts.values())


def test_a_cloud_with_pairs(spark):
    pages = spark.createDataFrame([("public license of the public license",)] * 9 + [("a city and cities",)], "text string")
    got = {r["word"]: r["count"] for r in pairs.cloud_with_pairs(pages, stop=frozenset({"of", "the", "and"})).collect()}
    assert got == {"license": 18, "public": 18, "city": 2}  # of three pairs all are the same: no sign of more than chance
    more = pages.unionByName(spark.createDataFrame([("some other words here",)] * 9, "text string"))
    got = {r["word"]: r["count"] for r in pairs.cloud_with_pairs(more, stop=frozenset({"of", "the", "and", "some", "here"})).collect()}
    assert got == {"public license": 18, "city": 2, "other words": 9}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_pages_are_ranked_in_blocks(spark, block):
    rows = [("x", f"t{k % 4}", k, (k * 7) % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "book_id string, term string, page_idx int, busy long")
    wanted = []
    for term in {r[1] for r in rows}:
        own = sorted((r[3], r[2]) for r in rows if r[1] == term)
        wanted += [("x", term, page, busy, k) for k, (busy, page) in enumerate(own, 1)]
    got = reports._ranked(df, block).select("book_id", "term", "page_idx", "busy", F.col("nth").cast("int"))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
