"""Index and reports as lines of text, Markdown and HTML. Terms and labels are not escaped unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import upper_first
from folioscope.operators.index import joined_runs, page_runs
from folioscope.storage import stored

#: Links of a term that a report shows.
MOST_LINKS = 15


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _line(lines: DataFrame, line: Column) -> DataFrame:
    return lines.select("book_id", "display_term", line.alias("line"))


def text_lines(lines: DataFrame) -> DataFrame:
    return _line(lines, F.concat("display_term", F.lit(": "), "pages"))


def markdown_lines(lines: DataFrame) -> DataFrame:
    return _line(lines, F.concat(F.lit("**"), "display_term", F.lit("**: "), "pages", F.lit("  ")))


def html_lines(lines: DataFrame, escape: bool = False) -> DataFrame:
    term = escaped(F.col("display_term")) if escape else F.col("display_term")
    return _line(lines, F.concat(F.lit("<div><b>"), term, F.lit("</b>: "), "pages", F.lit("</div>")))


def active_lines(occ: DataFrame, capitalize: bool = False) -> DataFrame:
    """Lines with a link for each end of a run; every raw term has its own, also where capitals make two alike."""

    def link(idx: str, label: str) -> Column:
        return F.concat(F.lit('<a href="#'), F.col(idx).cast("string"), F.lit("|"), "term", F.lit('">'), label, F.lit("</a>"))

    both = F.when(F.col("first_idx") == F.col("last_idx"), link("first_idx", "first_label")).otherwise(F.concat_ws("-", link("first_idx", "first_label"), link("last_idx", "last_label")))
    runs = joined_runs(page_runs(occ), both)
    shown = upper_first(F.col("term")) if capitalize else F.col("term")
    return runs.select("book_id", F.col("term").alias("display_term"), F.concat(F.lit("<div><b>"), shown, F.lit("</b>: "), "pages", F.lit("</div>")).alias("line"))


#: The style of links in the active index.
LINK_STYLE = "<html><head><style>a { text-decoration: none; color: blue; } a:hover { text-decoration: underline; }</style></head>"


def heading(count: int, kind: str) -> str:
    return {"active": f"{LINK_STYLE}<body><h1>Active Index ({count} entries)</h1>", "markdown": f"# Index ({count} entries)\n", "text": f"Index ({count} entries)\n", "html": f"<html><body><h1>Index ({count} entries)</h1>"}[kind]


def write_lines(lines: DataFrame, path: str, kind: str) -> None:
    """The heading and then the lines in order, as text files; a range sort, so no task has all lines."""
    top = lines.sparkSession.createDataFrame([(-1, "", heading(lines.count(), kind))], "k int, s string, value string")
    end = lines.sparkSession.createDataFrame([(1, "", "</body></html>")] if kind in ("html", "active") else [], "k int, s string, value string")
    body = lines.select(F.lit(0).alias("k"), F.lower("display_term").alias("s"), F.col("line").alias("value"))
    top.unionByName(body).unionByName(end).orderBy("k", "s", "value").select("value").write.text(path)


def _string(value: Column) -> Column:
    """A JSON string; characters beyond ASCII are written by their UTF-16 units."""
    quoted = F.substring(F.to_json(F.struct(value.alias("x"))), 6, 1 << 30)
    plain = F.regexp_replace(quoted, r"\}$", "")
    units = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")))
    bare = F.concat(F.lit('"'), value, F.lit('"'))
    return F.when(value.rlike("^[0-9A-Za-z #.,-]*$"), bare).when(plain.rlike(r"[^\x00-\x7F]"), F.array_join(units, "")).otherwise(plain)


def _pair(page_idx: Column, page_label: Column) -> Column:
    return F.concat(F.lit("    [\n      "), page_idx.cast("string"), F.lit(",\n      "), F.coalesce(_string(page_label), F.lit("null")), F.lit("\n    ]"))


def json_lines(index: DataFrame) -> DataFrame:
    """(book_id, term, line): an entry of a raw index as a member of the index's JSON object, its pages as pairs of place and
    label, two spaces to a level, other characters than ASCII escaped."""
    pairs = F.transform("pages", lambda p: _pair(p["page_idx"], p["page_label"]))
    return index.select("book_id", "term", F.concat(F.lit("  "), _string(F.col("term")), F.lit(": [\n"), F.array_join(pairs, ",\n"), F.lit("\n  ]")).alias("line"))


def write_json(index: DataFrame, path: str) -> None:
    """The raw index, or occ, of each book as one JSON object {term: [[place, label], ...]}: a folder for each book, whose text files
    in their order are the object. Entries go by their first page and spelling. Rows are pairs, so that an entry of very many
    pages is written by many tasks, and may go on in the next file."""
    each = index.select("book_id", "term", F.explode_outer("pages").alias("p")).select("book_id", "term", "p.page_idx", "p.page_label") if "pages" in index.columns else index
    rows = stored(each.select("book_id", "term", "page_idx", "page_label", F.monotonically_increasing_id().alias("nth")), "pairs")
    entries = stored(rows.groupBy("book_id", "term").agg(F.min("page_idx").alias("first"), F.max(F.struct("page_idx", "page_label", "nth"))["nth"].alias("last")), "entries")
    ends = entries.groupBy("book_id").agg(F.max(F.struct("first", "term"))["term"].alias("last_term"))
    place = ["book_id", "k", "first", "term", "step", "page_idx", "page_label", "nth"]

    def at(df: DataFrame, k: int, step: int, value: Column) -> DataFrame:
        have = df.select("*", F.lit(k).alias("k"), F.lit(step).alias("step"), value.alias("value"))
        return have.select(*[F.col(c) if c in have.columns else F.lit(None).alias(c) for c in place], "value")

    opened = at(entries, 1, 0, F.concat(F.lit("  "), _string(F.col("term")), F.lit(": [")))
    closed = at(entries.join(ends, "book_id"), 1, 2, F.when(F.col("term") == F.col("last_term"), "  ]").otherwise("  ],"))
    paired = at(rows.where("page_idx is not null").join(entries, ["book_id", "term"]), 1, 1, F.when(F.col("nth") == F.col("last"), "").otherwise(","))
    frame = at(ends, 0, 0, F.lit("{")).unionByName(at(ends, 2, 0, F.lit("}")))
    in_order = opened.unionByName(paired).unionByName(closed).unionByName(frame).orderBy(*place)
    # Pairs are put into words after the sort, whose sample reads all rows once more.
    value = F.when((F.col("k") == 1) & (F.col("step") == 1), F.concat(_pair(F.col("page_idx"), F.col("page_label")), F.col("value"))).otherwise(F.col("value"))
    in_order.select("book_id", value.alias("value")).write.partitionBy("book_id").text(path)


def finding_lines(findings: DataFrame) -> DataFrame:
    """(report_id, key, html) of reports.findings: escaped, terms joined by `; `."""
    return findings.select("report_id", "key", F.concat(F.lit("<p>"), escaped(F.array_join("terms", "; ")), F.when(F.col("note") != "", F.concat(F.lit(" ("), escaped(F.col("note")), F.lit(")"))).otherwise(""), F.lit("</p>")).alias("html"))


def report_links(index: DataFrame) -> DataFrame:
    """(book_id, term, links, more): the first pages as `label` or `label (PDF p.N)`, and how many more there are."""
    ref = F.transform("pages", lambda p: F.when(p["page_label"] == (p["page_idx"] + 1).cast("string"), p["page_label"]).otherwise(F.concat(p["page_label"], F.lit(" (PDF p."), (p["page_idx"] + 1).cast("string"), F.lit(")"))))
    return index.select("book_id", "term", F.array_join(F.slice(ref, 1, MOST_LINKS), ", ").alias("links"), F.greatest(F.size("pages") - MOST_LINKS, F.lit(0)).alias("more"))
