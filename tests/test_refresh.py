"""Findings brought up to date against those of a full run."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import refresh, reports

SCHEMA = "book_id string, term string, page_idx int, page_label string"
WORDS = ["Ring", "ring", "red ring", "Red Ring", "ring-red", "British Broadcasting Corporation", "BBC", "colour", "color", "iron", "!!"]


def book(name, draw, n=40):
    return {(name, draw.choice(WORDS), draw.randrange(30)) for _ in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(b, t, p, str(p + 1)) for b, t, p in sorted(rows)], SCHEMA)


def found(df):
    return sorted((r["report_id"], r["book_id"], r["key"], tuple(r["terms"]), r["note"]) for r in df.collect())


def full(spark, rows):
    return found(reports.findings(frame(spark, rows), spark.createDataFrame([], "word string"), reports=refresh.OF_BOOKS))


def changed(spark, gone, new):
    rows = [(b, t, p, str(p + 1), "delete") for b, t, p in gone] + [(b, t, p, str(p + 1), "insert") for b, t, p in new]
    return spark.createDataFrame(rows, f"{SCHEMA}, change string")


@pytest.fixture(scope="module")
def begun(spark):
    draw = random.Random(11)
    rows = set().union(*[book(f"b{k}", draw) for k in range(6)])
    return rows, refresh.create(frame(spark, rows), parts=8)


def test_a_refresh_gives_what_a_full_run_gives(spark, begun, tmp_path):
    rows, store = begun
    assert found(store.findings()) == full(spark, rows)
    gone = {r for r in rows if r[0] == "b1"} | {r for r in rows if r[0] == "b2" and r[1] in ("Ring", "color")} | {("b3", "none", 1)}
    new = {("b2", "Colours", 3), ("b2", "colour", 4), ("b9", "iron", 1), ("b9", "irons", 1)} | {r for r in rows if r[0] == "b4"}
    after = store.refresh(changed(spark, gone, new))
    now = (rows - gone) | new
    assert after.version == 1 and sorted((r["book_id"], r["term"], r["page_idx"]) for r in after.occurrences().collect()) == sorted(now)
    assert found(after.findings()) == full(spark, now)
    assert found(store.findings()) == full(spark, rows)  # the version before is still there
    again = after.refresh(changed(spark, {("b2", "Colours", 3)}, {("b1", "iron", 2)}))
    assert found(again.findings()) == full(spark, (now - {("b2", "Colours", 3)}) | {("b1", "iron", 2)})
    assert found(refresh.load(spark, store.path).findings()) == found(again.findings())
    assert found(refresh.load(spark, store.path, 1).findings()) == found(after.findings())


def test_parts_without_changes_are_not_read(spark, begun):
    rows, store = begun
    part = store.occurrences().select(refresh._part(8)).where("book_id = 'b5'").first()[0]
    after = store.refresh(changed(spark, set(), {("b5", "iron", 29)}))
    assert {p for p, folder in after.folders.items() if folder != store.folders[p]} == {part}
    files = {r[0] for r in store.occurrences([part]).select(F.input_file_name()).distinct().collect()}
    assert files and all(f"/part={part}/" in f for f in files)
    written = {r[0] for r in spark.read.parquet(f"{store.path}/occ-{after.folders[part]}").select("part").distinct().collect()}
    assert written == {part}


def test_no_changes_and_no_books(spark, begun):
    rows, store = begun
    assert store.refresh(changed(spark, set(), set())) is store
    none = refresh.create(frame(spark, set()), parts=2)
    assert none.findings().count() == none.occurrences().count() == 0
    assert found(none.refresh(changed(spark, set(), rows)).findings()) == full(spark, rows)
    with pytest.raises(ValueError):
        refresh.create(frame(spark, rows), reports=("unused_include_terms",))
