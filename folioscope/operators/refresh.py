"""Findings that are kept beside their occurrences, and brought up to date by changes.

Reports look at one book at a time, so a change of a book touches that book's findings and no others. Books lie in parts by a
hash of their id; a refresh reads the parts of the changed books only, works their findings out anew, and writes those parts
as a new version. Nothing is overwritten: a version's manifest says in which folder each part is, and is written last, in one file,
so that a refresh which does not come to its end leaves the last version as it was, and can be run again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import reports
from folioscope.storage import new_path

#: Reports of one book; which keywords no book uses is asked of all of them together.
OF_BOOKS = tuple(r for r in reports.REPORTS if r != "unused_include_terms")
PARTS = 256
_OCC = "book_id string, term string, page_idx int, page_label string"
_FOUND = "report_id string, book_id string, key string, terms array<string>, note string"
_MANIFEST = "version int, folder_of string, part int, folder string"


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("book_id"), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class FindingsStore:
    """A version of the stored relations: folders says in which folder each part is; options are those of reports.findings."""

    spark: SparkSession
    path: str
    version: int
    parts: int
    folders: dict[int, str]
    options: dict[str, object]

    def _read(self, name: str, schema: str, parts: list[int] | None) -> DataFrame:
        by: dict[str, list[int]] = {}
        for part, folder in sorted(self.folders.items()):
            if parts is None or part in parts:
                by.setdefault(folder, []).append(part)
        read = [self.spark.read.schema(f"{schema}, part int").parquet(f"{self.path}/{name}-{folder}").where(F.col("part").isin(own)).drop("part") for folder, own in by.items()]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    def occurrences(self, parts: list[int] | None = None) -> DataFrame:
        """occ(book_id, term, page_idx, page_label), of some parts or all."""
        return self._read("occ", _OCC, parts)

    def findings(self, parts: list[int] | None = None) -> DataFrame:
        """(report_id, book_id, key, terms, note), as reports.findings has them."""
        return self._read("findings", _FOUND, parts)

    def _written(self, occ: DataFrame, found: DataFrame, version: int, parts: list[int]) -> FindingsStore:
        fresh = f"{version}-{uuid.uuid4().hex}"
        for name, rows in (("occ", occ), ("findings", found)):
            own = rows.withColumn("part", _part(self.parts))
            own.repartition("part", F.xxhash64("book_id")).write.partitionBy("part").parquet(f"{self.path}/{name}-{fresh}")
        folders = {**self.folders, **dict.fromkeys(parts, fresh)}
        rows = [(version, fresh, part, folder) for part, folder in folders.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return FindingsStore(self.spark, self.path, version, self.parts, folders, self.options)

    def _found(self, occ: DataFrame) -> DataFrame:
        return reports.findings(occ, self.spark.createDataFrame([], "word string"), **self.options).select("report_id", "book_id", "key", "terms", "note")

    def refresh(self, changes: DataFrame) -> FindingsStore:
        """The next version, after changes (book_id, term, page_idx, page_label, change): change is `insert` or `delete`.

        Deletes come first; one of what is not there, and an insert of what is, change nothing. Books that are new get their findings, and of
        books without occurrences left none stay. Without changes this is the same version."""
        keys = ["book_id", "term", "page_idx"]
        known = changes.where(F.col("change").isin("insert", "delete"))
        parts = sorted(r[0] for r in known.select(_part(self.parts).alias("part")).distinct().collect())  # as many as there are parts at most
        if not parts:
            return self
        books = known.select("book_id").distinct()
        old = self.occurrences(parts)
        left = old.join(known.where("change = 'delete'").select(*keys).distinct(), keys, "left_anti")
        fresh = known.where("change = 'insert'").groupBy(*keys).agg(F.min("page_label").alias("page_label")).select("book_id", "term", F.col("page_idx").cast("int").alias("page_idx"), "page_label")
        occ = left.unionByName(fresh.join(left.select(*keys), keys, "left_anti"))
        again = self._found(occ.join(books, "book_id", "left_semi"))
        same = self.findings(parts).join(books, "book_id", "left_anti")
        return self._written(occ, same.unionByName(again), self.version + 1, parts)


def create(occ: DataFrame, path: str | None = None, parts: int = PARTS, **options: object) -> FindingsStore:
    """A store of occ(book_id, term, page_idx, page_label) and its findings, at version 0. options: those of reports.findings, which
    reports to run among them; `reports` has those of OF_BOOKS by default and may have no other."""
    chosen = {"reports": OF_BOOKS, **options}
    if not set(chosen["reports"]) <= set(OF_BOOKS):
        raise ValueError(f"reports are some of {OF_BOOKS}")
    spark = occ.sparkSession
    empty = FindingsStore(spark, path or new_path(spark, "findings-store"), 0, parts, {}, chosen)
    own = occ.select("book_id", "term", F.col("page_idx").cast("int").alias("page_idx"), "page_label")
    return empty._written(own, empty._found(own), 0, list(range(parts)))


def load(spark: SparkSession, path: str, version: int | None = None, **options: object) -> FindingsStore:
    """The last version whose manifest was written, or an earlier one; options as they were given to create. Of two refreshes of one
    version one counts, whole."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").where(F.lit(True) if version is None else F.col("version") == version).collect()
    last, own = max((r["version"], r["folder_of"]) for r in rows)
    folders = {r["part"]: r["folder"] for r in rows if r["folder_of"] == own}
    return FindingsStore(spark, path, last, max(folders) + 1, folders, {"reports": OF_BOOKS, **options})
