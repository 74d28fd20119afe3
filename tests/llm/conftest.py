import os
import random

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


def prose(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}x{draw.randrange(9)}" for _ in range(n))


def hard_texts():
    """Texts with what is awkward: copies, near copies, chains of them, shared passages, periods, nothing, a very long one."""
    draw = random.Random(4)
    passage = prose(draw, 80)
    base = prose(draw, 200).split()
    texts = [None, "", " \n\t", "word", "Word", "a b c d", "a b c d e", "A B C D E", "é É ß\x00\x07", "x" * 900, "ab" * 500]
    for _ in range(40):  # shares a passage, but is another text
        texts.append(prose(draw, draw.randrange(5, 60)) + " " + passage + " " + prose(draw, draw.randrange(5, 60)))
    chain = list(base)
    for k in range(40):  # each is near the last one, the ends are far apart
        chain[(7 * k) % 200] = f"new{k}"
        texts.append(" ".join(chain))
    for k in range(40):  # near copies of one text
        own = list(base)
        own[draw.randrange(200)] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 30 + [" ".join(base).upper()] * 3
    texts += [prose(draw, draw.randrange(1, 300)) for _ in range(60)]
    texts.append(prose(draw, 20000))
    texts += [None, "", "word", passage, passage[:250] + " " + passage[250:500]]
    draw.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def hard(spark):
    rows = list(enumerate(hard_texts()))
    rows += [(None, "word"), (None, None), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.selectExpr("doc_id", "text", "'z' as digest", "1 as kept", "2 as shard", "'q' as spans", "cast(null as map<string,int>) as `odd.name`"), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
