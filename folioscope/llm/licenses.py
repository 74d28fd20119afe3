"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over a text's words, joined by single spaces. Rules are hand-written (`license_signatures`), or
made of license families, versions and ways of writing. They are tried in their order of priority; a detection inside the span of one of higher priority, or inside a longer one of the same, is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import license_signatures
from folioscope.llm.common import SEPARATORS, alnum_words, batches, quoted, utf8

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License families: label, names by which texts call them, versions that exist, and a word that every name contains.
FAMILIES = [
    ("gpl", ["gnu general public licen[cs]e", "gnu gpl", "gpl"], ["1 0", "2 0", "3 0"], ["general public", "gpl"]),
    ("lgpl", ["gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "gnu lgpl", "lgpl"], ["2 0", "2 1", "3 0"], ["general public", "lgpl"]),
    ("agpl", ["gnu affero general public licen[cs]e", "affero general public licen[cs]e", "gnu agpl", "agpl"], ["1 0", "3 0"], ["affero", "agpl"]),
    ("gfdl", ["gnu free documentation licen[cs]e", "gfdl"], ["1 1", "1 2", "1 3"], ["free documentation", "gfdl"]),
    ("apache", ["apache software licen[cs]e", "apache licen[cs]e", "asl"], ["1 0", "1 1", "2 0"], ["apache", "asl"]),
    ("mpl", ["mozilla public licen[cs]e", "mpl"], ["1 0", "1 1", "2 0"], ["mozilla", "mpl"]),
    ("epl", ["eclipse public licen[cs]e", "epl"], ["1 0", "2 0"], ["eclipse", "epl"]),
    ("cddl", ["common development and distribution licen[cs]e", "cddl"], ["1 0", "1 1"], ["common development", "cddl"]),
    ("cpl", ["common public licen[cs]e"], ["1 0"], ["common public"]),
    ("eupl", ["european union public licen[cs]e", "eupl"], ["1 0", "1 1", "1 2"], ["european union", "eupl"]),
    ("osl", ["open software licen[cs]e"], ["1 0", "2 0", "2 1", "3 0"], ["open software"]),
    ("afl", ["academic free licen[cs]e"], ["1 1", "1 2", "2 0", "2 1", "3 0"], ["academic free"]),
    ("artistic", ["artistic licen[cs]e"], ["1 0", "2 0"], ["artistic"]),
    ("bsl", ["boost software licen[cs]e"], ["1 0"], ["boost software"]),
    ("ms-pl", ["microsoft public licen[cs]e"], [], ["microsoft public"]),
    ("ms-rl", ["microsoft reciprocal licen[cs]e"], [], ["microsoft reciprocal"]),
    ("zpl", ["zope public licen[cs]e"], ["1 1", "2 0", "2 1"], ["zope"]),
    ("php", ["php licen[cs]e"], ["3 0", "3 01"], ["php licen"]),
    ("python", ["python software foundation licen[cs]e", "psf licen[cs]e"], ["2 0"], ["python software", "psf"]),
    ("ofl", ["sil open font licen[cs]e", "open font licen[cs]e"], ["1 0", "1 1"], ["open font"]),
    ("odbl", ["open database licen[cs]e", "odbl"], ["1 0"], ["open database", "odbl"]),
    ("odc-by", ["open data commons attribution licen[cs]e"], ["1 0"], ["data commons"]),
    ("cecill", ["cecill(?: free software)? licen[cs]e", "cecill"], ["1 0", "2 0", "2 1"], ["cecill"]),
    ("mit", ["mit licen[cs]e", "expat licen[cs]e"], [], ["mit licen", "expat"]),
    ("isc", ["isc licen[cs]e"], [], ["isc licen"]),
    ("bsd", ["bsd licen[cs]e"], [], ["bsd"]),
    ("bsd-2-clause", ["bsd 2 clause(?: licen[cs]e)?", "2 clause bsd(?: licen[cs]e)?", "simplified bsd licen[cs]e", "freebsd licen[cs]e"], [], ["bsd", "freebsd", "simplified bsd", "2 clause bsd"]),
    ("bsd-3-clause", ["bsd 3 clause(?: licen[cs]e)?", "3 clause bsd(?: licen[cs]e)?", "new bsd licen[cs]e", "modified bsd licen[cs]e"], [], ["bsd"]),
    ("unlicense", ["the unlicen[cs]e"], [], ["unlicen"]),
    ("wtfpl", ["wtfpl"], ["2 0"], ["wtfpl"]),
    ("zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e"], [], ["zlib"]),
    ("cc0", ["cc0", "creative commons zero"], ["1 0"], ["cc0", "commons zero"]),
    ("public-domain", ["(?:released|placed|dedicated) (?:in|in|to|into) the public domain", "public domain dedication"], [], ["public domain"]),
]
#: Creative Commons elements; each combination, version and way of writing makes a rule.
CC_ELEMENTS = [("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # the lower, the earlier
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]  # one of them is in every text that the pattern matches
    confidence: float


def _rule(label: str, priority: int, pattern: str, keywords: list[str], confidence: float) -> Rule:
    return Rule(label, priority, re.compile(rf" (?:{pattern})(?= )".encode()), tuple(k.encode() for k in keywords), confidence)


def _written(lines: str, priority: int, confidence: float) -> Iterator[Rule]:
    for line in lines.strip().split("\n"):
        label, keyword, pattern = line.split(" | ")
        yield _rule(label, 2 if label.endswith("-or-later") and priority > 2 else priority, pattern, [keyword], confidence)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules by priority: sentences, SPDX tags, names with version and clause, names with version, names alone.

    What is hand-written comes first among those of one priority; the families add their versions and ways of writing."""
    out = [
        *_written(license_signatures.GRANTS, 0, 0.95), *_written(license_signatures.EXPRESSIONS, 1, 1.0), *_written(license_signatures.VERSIONED, 3, 0.9), *_written(license_signatures.NAMES, 4, 0.7),
    ]
    for label, names, versions, keys in FAMILIES:
        short = label.replace("-", " ")
        out.append(_rule(label, 1, rf"spdx license identifier {short}", ["spdx"], 1.0))
        for version in versions:
            major, minor = version.split(" ")
            dotted = f"{label}-{major}.{minor}"
            number = rf"{major} {minor}" if minor != "0" else rf"{major}(?: 0)?"
            out.append(_rule(dotted, 1, rf"spdx license identifier {short} {version}(?: only)?", ["spdx"], 1.0))
            out.append(_rule(f"{dotted}-or-later", 1, rf"spdx license identifier {short} {version} or later", ["spdx"], 1.0))
            for name in names:
                out.append(_rule(f"{dotted}-or-later", 2, rf"(?:{name}) (?:version |v ?)?{number} or (?:\(?at your option\)? )?(?:any )?later(?: version)?", keys, 0.95))
                out.append(_rule(dotted, 3, rf"(?:{name}) (?:version |v ?)?{number}", keys, 0.9))
        for name in names:
            out.append(_rule(label, 4, rf"(?:{name})", keys, 0.8 if " " in name else 0.4))
    for code, spelled in CC_ELEMENTS:
        label = "cc-" + code.replace(" ", "-")
        for version in CC_VERSIONS:
            dotted = f"{label}-{version.replace(' ', '.')}"
            number = version.removesuffix(" 0") + ("(?: 0)?" if version.endswith(" 0") else "")
            out.append(_rule(dotted, 1, rf"spdx license identifier cc {code} {version}", ["spdx"], 1.0))
            out.append(_rule(dotted, 3, rf"cc {code} (?:version |v ?)?{number}", ["cc by"], 0.9))
            out.append(_rule(dotted, 3, rf"creative commons {spelled} (?:version |v ?)?{number}", ["creative commons"], 0.9))
            out.append(_rule(dotted, 3, rf"creativecommons org licenses {code} {version}", ["creativecommons"], 0.95))
        out.append(_rule(label, 4, rf"cc {code}", ["cc by"], 0.6))
        out.append(_rule(label, 4, rf"creative commons {spelled}(?: licen[cs]e)?", ["creative commons"], 0.8))
    return tuple(sorted(out, key=lambda r: r.priority))


@cache
def _prefilter() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    """An automaton over all keywords, and the rules that each of them admits."""
    by: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for key in rule.keywords:
            by.setdefault(key.decode(), []).append(i)
    automaton = ahocorasick.Automaton()
    for key in [*by, *BASE_PHRASES]:
        automaton.add_word(f" {key}", key)  # keywords begin words
    automaton.make_automaton()
    return automaton, by


@dataclass(frozen=True)
class Detection:
    label: str
    start: int  # of the first word, from 0
    end: int  # after the last word
    confidence: float


def _uncovered(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """Detections (start, end, rule's number, rule) that are not inside one of higher priority, or inside a longer one (of equal
    ones a later one) of the same. In one sweep by start: who is inside a suppressed one is inside that one's suppressor too."""
    found.sort(key=lambda x: (x[0], -x[1], x[3].priority, x[2]))
    reach: dict[int, int] = {}  # priority: furthest end so far
    kept = []
    for start, end, number, rule in found:
        if not any(far >= end for priority, far in reach.items() if priority <= rule.priority):
            kept.append((start, end, number, rule))
        reach[rule.priority] = max(reach.get(rule.priority, -1), end)
    return kept


def _joined(words: list[bytes]) -> bytes:
    """The words between and around single spaces."""
    return b" " + b" ".join(words) + b" "


def detect(joined: bytes, keys: set[str]) -> list[Detection]:
    """What the rules admitted by some keywords find in joined words, sorted by place."""
    by, all_rules = _prefilter()[1], rules()
    found: list[tuple[int, int, int, Rule]] = []
    for i in sorted({i for key in keys for i in by.get(key, ())}):  # in the order of priority
        rule = all_rules[i]
        group = 1 if rule.pattern.groups else 0
        found += [(m.start(group) + (not group), m.end(group), i, rule) for m in rule.pattern.finditer(joined)]
    kept = _uncovered(found)
    if not kept:
        return []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts, ends = (np.searchsorted(spaces, [x[k] for x in kept]).tolist() for k in (0, 1))
    return [Detection(x[3].label, s - 1, e, x[3].confidence) for x, s, e in zip(kept, starts, ends, strict=True)]


#: A plus after a number, at the end of a word: `2.0+`.
_PLUS = re.compile(rb"(?<=[0-9])\+(?![0-9A-Za-z+\x80-\xff])")


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[Detection]]:
    """(words, base places, first, last, base labels, detections) of a text. Linear in the text but for its detections, which are
    sorted."""
    words = alnum_words(text)
    joined = _joined(words)
    automaton, _ = _prefilter()
    keys = {key for _, key in automaton.iter(joined.decode("latin-1"))}
    if not keys:
        return len(words), 0, None, None, [], []
    places: list[int] = []
    labels: set[str] = set()
    for phrase, label in BASE_PHRASES.items():
        if phrase not in keys:
            continue
        wanted = f" {phrase} ".encode()
        at = joined.find(wanted)
        while at >= 0:
            places.append(at)
            labels.add(label)
            at = joined.find(wanted, at + 1)
    if places:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        first, last = np.searchsorted(spaces, [min(places), max(places)]).tolist()
    else:
        first = last = None
    data = utf8(text)
    if _PLUS.search(data):  # such a plus stays with its word, so words keep their numbers
        marked = _PLUS.sub(b"\xff", data).lower().translate(SEPARATORS)  # a byte that is never in UTF-8
        joined = _joined([w.replace(b"\xff", b"+") for w in marked.split()])
    return len(words), len(places), first, last, sorted(labels), detect(joined, keys)


_OUT = pa.schema([
    ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
    ("detections", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))),
])


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                *base, found = scan_text(text.as_py())
                yield i, *base, [vars(d) for d in found]

    yield from batches(rows(), _OUT)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, detections), a row for each row of docs.

    Base: places where the words of a base phrase stand consecutively. Detections: what the rules find, after
    suppression. Null and empty texts have no words and no labels; repeated rows give repeated results; an empty table
    gives none; other columns are not read. One pass without a shuffle: a text is scanned where it is read.
    """
    own, text = quoted([id_col, text_col])
    rows = docs.select(own.cast("long").alias("id"), text.alias("text"))
    return rows.mapInArrow(
        _scan,
        "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "detections array<struct<label: string, start: long, end: long, confidence: double>>",
    )
