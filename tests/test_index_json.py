"""Reading of index objects that are split anywhere."""

import json

import pytest

from folioscope.operators import index, render
from folioscope.sources.index_json import read_index

INDEX = {
    "plain": [[0, "1"], [4, "5"], [9, "x"]], "a]b": [[1, "]"], [2, "[2]"]], 'quo"te\\': [[3, 'q"]"'], [4, "\\"]], "empty": [], "nach\nbar {x}": [[5, "é"], [6, "\U0001f600"]],
    "],[": [[7, "\\]"]], "many": [[k, f"p{k}"] for k in range(300)], "": [[8, ""]], "last": [[9, ":"]],
}


def expected(index, book="b"):
    return sorted((book, term, i, label) for term, pages in index.items() for i, label in pages)


@pytest.mark.parametrize("split", [1 << 27, 700, 97])
@pytest.mark.parametrize("style", [{"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_an_object_is_read_whatever_its_splits(spark, tmp_path, split, style):
    path = tmp_path / "index.json"
    path.write_text(json.dumps(INDEX, **style), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if split < 1000:
            assert spark.read.option("lineSep", "]").text(str(path)).rdd.getNumPartitions() > 5
        got = sorted(map(tuple, read_index(spark, str(path), "b").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == expected(INDEX)


def test_empty_objects_and_several_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text("{}")
    assert read_index(spark, str(tmp_path / "a")).count() == 0
    (tmp_path / "a" / "2.json").write_text(json.dumps({"x": [[1, "1"]], "y": []}))
    (tmp_path / "a" / "3.json").write_text(json.dumps({"x": [[2, "2"]]}))
    assert sorted(map(tuple, read_index(spark, str(tmp_path / "a"), "z").collect())) == [("z", "x", 1, "1"), ("z", "x", 2, "2")]


def test_what_is_written_is_read(spark, tmp_path):
    rows = [(b, term, i, label) for b in ("one", "two") for _, term, i, label in expected(INDEX) if term]
    occ = spark.createDataFrame(rows, "book_id string, term string, page_idx int, page_label string")
    render.write_json(index.nested(occ), str(tmp_path / "out"))
    assert sorted(map(tuple, read_index(spark, str(tmp_path / "out")).collect())) == sorted(rows)


def test_an_entry_is_written_by_many_tasks(spark, tmp_path):
    wanted = {"a]": [[k, str(k + 1)] for k in range(0, 900)], 'b"]é': [[k, f'{k}"]'] for k in range(1, 700)], "c": [[2, "]"]]}
    rows = [("one", term, i, label) for term, pages in wanted.items() for i, label in pages]
    occ = spark.createDataFrame(rows, "book_id string, term string, page_idx int, page_label string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else tasks this small are put together
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        render.write_json(occ, str(tmp_path / "out"))
        got = sorted(map(tuple, read_index(spark, str(tmp_path / "out")).collect()))
    finally:
        for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
    files = sorted((tmp_path / "out" / "book_id=one").glob("*.txt"))
    assert len(files) > 4
    assert "".join(f.read_text(encoding="utf-8") for f in files) == json.dumps(wanted, indent=2) + "\n"
    assert got == sorted(rows)
