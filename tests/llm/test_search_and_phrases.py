"""Fingerprints, ranked search and phrases against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from folioscope.llm import collocations, edit_embedding, ranked_search
from folioscope.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.brute import WORD, lower


def edits(text, n, draw, letters="abcdefg hij"):
    out = list(text)
    for _ in range(n):
        k = draw.randrange(len(out) + 1)
        kind = draw.randrange(3)
        out[k : k + (kind > 0)] = [draw.choice(letters)] if kind < 2 else []
    return "".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# Fingerprints


def plain_walk(text):
    classes = edit_embedding.classes(text).tolist()
    steps = set(edit_embedding._STEPS[edit_embedding._STEPS < 1 << 24].tolist())
    at, step, out, moves = 0, 0, bytearray(), []
    while at < len(classes):
        if step >= len(moves):
            moves += edit_embedding._moves(len(moves), len(moves) + 4096).tolist()
        if step in steps:
            out.append(edit_embedding.SYMBOLS[classes[at]])
        at += moves[step] >> classes[at] & 1
        step += 1
    return bytes(out)


def test_walks_are_those_of_one_text_alone():
    draw = random.Random(2)
    texts = ["".join(draw.choice("abc dé\U0001f600") for _ in range(draw.choice([0, 1, 2, 30, 700, 3000]))) for _ in range(150)] + ["x" * 40000]
    wanted = [plain_walk(t) for t in texts]
    assert edit_embedding.fingerprints(texts) == wanted
    assert [edit_embedding.fingerprints([t])[0] for t in texts[:30]] == wanted[:30]


def test_likeness_falls_with_the_edits():
    draw = random.Random(3)
    near, half, other = [], [], []
    for _ in range(60):
        a, b = ("".join(draw.choice("abcdefg hij") for _ in range(2000)) for _ in range(2))
        fa, fn, fh, fb = edit_embedding.fingerprints([a, edits(a, 2, draw), edit_embedding.edited(a, b), b])
        near.append(edit_embedding.likeness(fa, fn))
        half.append(edit_embedding.likeness(fa, fh))
        other.append(edit_embedding.likeness(fa, fb))
    assert np.mean(near) > 0.8 > np.mean(half) > 0.4 > np.mean(other)
    assert edit_embedding.likeness(b"", b"") == 1.0 and edit_embedding.likeness(b"", b"A") == 0.0


def plain_fingerprints(rows):
    """Rows in falling order of id, then of text; nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    groups = defaultdict(list)
    for r in order:
        groups[r[0]].append(r[1] or "")
    flat = [(i, t) for i in dict.fromkeys(r[0] for r in order) for t in sorted(groups[i], key=str.encode, reverse=True)]
    out = []
    for k, (i, text) in enumerate(flat):
        after = flat[(k + 1) % len(flat)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        f, g, h = plain_walk(text), plain_walk(new), plain_walk(after)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), f.decode(), g.decode(), edit_embedding.likeness(f, g), edit_embedding.likeness(f, h)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_bytes", [1 << 30, 20000, 500])
def test_fingerprints_of_hard_texts(spark, hard, part_bytes):
    df, rows = hard
    got = sorted(map(tuple, edit_embedding.edit_fingerprints(df, part_bytes=part_bytes).collect()), key=repr)
    assert got == plain_fingerprints(rows)


def test_fingerprints_of_one_row_and_none(spark, empty):
    assert edit_embedding.edit_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(7, "abcd")], "`doc.id` long, text string")
    row = edit_embedding.edit_fingerprints(one, id_col="doc.id").first()
    assert (row["doc_id"], row["near_next"], row["edited_sha256"]) == (7, 1.0, hashlib.sha256(b"abab").hexdigest())


def test_registered_fingerprints(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_edit_fingerprints"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_fingerprints(rows)


def test_near_texts_against_brute_force(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdefg hij") for _ in range(draw.choice([40, 150, 400]))) for _ in range(60)]
    texts += [edits(t, max(1, len(t) // 50), draw) for t in texts for _ in range(2)]
    texts += ["", None, "ab", "ab", texts[0], "z" * 300]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as band", "'x' as q")
    got = {(r[0], r[1]): (r[2], r[3]) for r in edit_embedding.near_texts(docs, docs.where("doc_id % 5 = 0")).collect()}
    wanted = {}
    for i, a in rows[::5]:
        for j, b in rows:
            most = max(len(a or ""), len(b or ""))
            if abs(len(a or "") - len(b or "")) <= 0.2 * most:
                d = distance(a or "", b or "")
                if d <= 0.2 * most + 1e-9:
                    wanted[i, j] = (d, 1.0 if not most else 1 - d / most)
    assert got.items() <= wanted.items()
    assert len(got) >= 0.9 * len(wanted), (len(got), len(wanted))
    assert edit_embedding.near_texts(docs.limit(0), docs).count() == 0


# Ranked search


def plain_search(docs, items, top=50):
    words = [(i, WORD.findall(lower(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    counts = [Counter(w) for _, w in words]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, w), c in zip(words, counts, strict=True):
            m = 50 + 50 * len(w) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(WORD.findall(lower(text))) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def test_ranked_search_on_hard_texts(spark, hard, monkeypatch):
    df, rows = hard
    items = [(0, "w1x1 w2x3 W1X1 w77x0"), (1, None), (2, ""), (3, "word é É ß"), (3, "word"), (4, " ".join(t for _, t in rows[:60] if t)), (None, "a b c")]
    table = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id int, text string, score int, rank string")
    for tiles in ((256, 2048, 1024), (2, 16, 7)):
        for name, value in zip(("ITEM_TILE", "WORD_TILE", "DOCUMENT_TILE"), tiles, strict=True):
            monkeypatch.setattr(ranked_search, name, value)
        got = ranked_search.ranked_search(df, table, top=5)
        assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(rows, items, 5)
    monkeypatch.setattr(ranked_search, "GROUP_BYTES", 400)  # items in several groups
    got = ranked_search.ranked_search(df, table, top=5)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(rows, items, 5)


def test_ranked_search_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(1000 + i, f"other text {i}") for i in range(50)]
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([("q", "words")], "item_id string, text string"), top=50)
    assert [r["doc_id"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == list(range(1, 51))


def test_ranked_search_of_nothing(spark, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(empty, items).count() == 0
    assert ranked_search.ranked_search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_impacts_beyond_64_bits():
    n = np.array([3, 10**9], np.int64)
    wanted = [10**9 * 2 // (2000 + 20 * (50 + 50 * int(x) * 10**10 // 10**13)) for x in n]
    assert ranked_search.impacts(np.array([2, 2]), n, 10**10, 10**13).tolist() == wanted


# Phrases


def plain_phrases(rows, least, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        longer = Counter()
        for p, c in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], c)
        kept = []
        for p, a in some.items():
            if 100 * longer[p] < 80 * a:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("least", "top", "group_rows"), [(3, 2000, 200_000), (2, 7, 40), (30, 2000, 5)])
def test_phrases_of_hard_texts(spark, least, top, group_rows, monkeypatch):
    draw = random.Random(6)
    words = ["the", "of", "New", "york", "é", "a", "b", "c d", "\x1f", "x-y"]
    rows = []
    for k in range(400):
        text = "".join(draw.choice(words[: 3 + k % 8]) + draw.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0c"]) for _ in range(draw.randrange(40)))
        rows.append((draw.choice(["en", "en", "de", None, ""]), text))
    rows += [("en", None), ("fr", ""), ("fr", " .\n"), ("en", "the end of the line " * 500), ("languages", "a b"), ("language2", "a b")] + [("en", "one passage of words that many share")] * 60
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(6)
    monkeypatch.setattr(collocations, "BATCH_WORDS", 700)
    got = collocations.collocations(df, least=least, top=top, group_rows=group_rows)
    assert sorted(map(tuple, got.select(*PHRASE).collect())) == plain_phrases(rows, least, top)


def test_phrases_where_every_pair_passes_the_table(spark, monkeypatch):
    rows = [("en", f"w{k % 3000} w{k % 7} w{k % 11} end") for k in range(6000)]
    monkeypatch.setattr(collocations, "LEAST_BITS", 11)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=30, most_bits=11)
    assert sorted(map(tuple, got.select(*PHRASE).collect())) == plain_phrases(rows, 30)


def test_phrases_of_nothing(spark, empty):
    assert collocations.collocations(empty).count() == 0


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_collocations"])
def test_registered_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got = QUERIES[name](spark, sf)
    rel = con.sql(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})")
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
