"""Which recurring lines go: the surroundings decide, however many copies there are."""

import random

from llm_fixtures import docs_of  # noqa: F401
from pyspark.sql import functions as F
from test_texts import WORDS, lines, prose, text_of

from tallywright.llm import bitmaps, line_templates

PASSAGE = "shared passage " + " ".join(WORDS[:40])


def dropped(docs_of, *rows):  # noqa: F811
    return {i: d for i, _, d in lines(docs_of, *rows)}


def copies(seed, n, passage=None):
    """A text of twelve lines and its near copies, one word in twenty-five changed."""
    own = [" ".join(prose(40_000 + seed * 100 + i, 9)) for i in range(12)]
    own = own[:5] + ([passage] if passage else []) + own[5:]
    r = random.Random(seed)
    edited = lambda line: " ".join(w if r.random() > 0.04 else "ed" + r.choice(WORDS) for w in line.split())
    return ["\n".join(line if line == passage else edited(line) for line in own) for _ in range(n)]


def test_a_passage_goes_from_copies_and_from_others(docs_of):  # noqa: F811
    rows = [(1000 + i, t) for i, t in enumerate(copies(5, 200, PASSAGE))]
    rows += [(i, text_of(i, PASSAGE)) for i in range(20)]
    found = dropped(docs_of, *rows)
    assert all(found[i] == [3] for i in range(20))
    assert all(5 in found[1000 + i] for i in range(200))


def test_lines_of_copies_alone_stay(docs_of):  # noqa: F811
    rows = [(i, t) for i, t in enumerate(copies(6, 120))]
    rows += [(1000 + i, text_of(50 + i)) for i in range(5)]
    assert sum(map(len, dropped(docs_of, *rows).values())) == 0


def test_two_documents_are_enough_for_a_long_line(docs_of):  # noqa: F811
    rows = [(1, text_of(1, PASSAGE)), (2, text_of(2, PASSAGE)), (3, text_of(3, "a short line of two")), (4, text_of(4, "a short line of two"))]
    rows += [(5, text_of(5, PASSAGE + " other end")), (6, text_of(7)), (7, text_of(7))]
    assert dropped(docs_of, *rows) == {1: [3], 2: [3], 3: [], 4: [], 5: [], 6: [], 7: []}


def test_a_document_of_many_lines(spark, docs_of):  # noqa: F811
    """A row of a line must not carry its document: 100,000 lines would be 100,000 times its length."""
    many = "\n".join(f"{w} {v}" for w in WORDS[:320] for v in WORDS[:320])
    rows = [(1, many), *[(i, text_of(i, "All rights reserved by the owners of this")) for i in range(2, 6)]]
    assert dropped(docs_of, *rows) == {1: [], **{i: [3] for i in range(2, 6)}}


def templates(line):
    """The templates of a line, as text."""
    tokens = ["<*>" if any(c.isdigit() for c in t) else t for t in line.lower().split()]
    n, found = len(tokens), {("whole", tuple(tokens))}
    step = n // line_templates.VARIABLE
    for at in range(line_templates.LEADING, n, step) if step else []:
        found.add((n, tuple(tokens[:at] + [None] * len(tokens[at : at + step]) + tokens[at + step :])))
    return found


def test_unlike_documents_match_brute_force(docs_of):  # noqa: F811
    """Without copies, a line goes if one of its templates stands in enough documents."""
    r = random.Random(31)
    pool = [" ".join(prose(5000 + i, r.choice([1, 3, 6, 11, 25]))) for i in range(12)]
    rows = []
    for i in range(40):
        shared = [" ".join(w if r.random() > 0.1 else r.choice(WORDS) for w in r.choice(pool).split()) for _ in range(r.randrange(3))]
        own = [" ".join(prose(9000 + 10 * i + j, 14)) for j in range(4)]
        rows.append((i, "\n".join(r.sample(own + shared, len(own) + len(shared)))))
    holders = {}
    for i, text in rows:
        for line in text.split("\n"):
            for t in templates(line):
                holders.setdefault(t, set()).add(i)
    least = lambda line: 2 if len(line.split()) >= line_templates.LONG_TOKENS else line_templates.LEAST_DOCUMENTS
    wanted = {
        i: [k for k, line in enumerate(text.split("\n")) if any(len(holders[t]) >= least(line) for t in templates(line))] for i, text in rows
    }
    assert dropped(docs_of, *rows) == wanted and any(wanted.values())


def test_a_bitmap_of_numbers_loses_no_template(spark):
    rows = spark.range(60_000).select(F.xxhash64("id").alias("key"), "id")
    some = rows.filter("id % 100 = 0").select("key").union(spark.createDataFrame([(-1,), (-(1 << 63),), ((1 << 63) - 1,)], "key long"))
    edges = spark.createDataFrame([(-1, -1), (-(1 << 63), -2), ((1 << 63) - 1, -3)], "key long, id long")
    found = [r.id for r in bitmaps.marked(rows.union(edges), "key", some).collect()]
    assert len(found) == len(set(found)) and {*range(0, 60_000, 100), -1, -2, -3} <= set(found)
    assert len(found) < 10_000  # 16 bits a hash: most others go
    assert bitmaps.marked(rows, "key", some.limit(0)).count() == 0
