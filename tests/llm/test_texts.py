"""Decontamination, line templates, language, near duplicates, tokens, toxicity and personal data on small tables."""

import random
import re
import string
import tracemalloc
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_fixtures import docs_of  # noqa: F401
from pyspark.sql.group import GroupedData

from tallywright.llm import (
    cross_parsing,
    decontaminate,
    duckdb_bpe,
    line_templates,
    order_minhash,
    pii_crf,
    queries,
    toxic_segments,
)

ODD = [(90, None), (91, ""), (92, " \n\t ... "), (None, "only text"), (93, "x" * 200_000), (94, "one"), (94, "one")]
WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=6)) for i in range(400)]


def prose(seed, n):
    return random.Random(seed).choices(WORDS, k=n)


# Decontamination


def best_windows(doc, item):
    """The most agreeing window of every diagonal, by trying all."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    d, b = split(doc), split(item)
    win, best = min(len(b), 20), None
    if len(b) < 8:
        return None
    for p in range(len(d) - win + 1):
        for q in range(len(b) - win + 1):
            n = sum(d[p + i] == b[q + i] for i in range(win))
            if n >= win - int(win * 0.2 + 1e-9) and (best is None or (n, -p) > best):
                best = (n, -p)
    return best and (best[0], -best[1])


def leaks(spark, docs_of, docs, items, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs_of(*docs), benchmark, **options).collect()
    return {(r.doc_id, r.item_id): (r.matched, r.start_word) for r in found}


@pytest.mark.parametrize("words", [decontaminate.BROADCAST_WORDS, 0])
def test_leaks_match_brute_force(spark, docs_of, words):
    r = random.Random(7)
    items = [(i, " ".join(prose(i, n))) for i, n in enumerate([8, 9, 11, 14, 15, 17, 20, 33, 60, 5])] + [(50, None), (51, "")]
    docs = []
    for k in range(60):
        body = prose(1000 + k, 60)
        passage = prose(*[(i, n) for i, n in enumerate([8, 9, 11, 14, 15, 17, 20, 33, 60])][k % 9])
        for at in r.sample(range(len(passage)), r.randrange(0, max(2, len(passage) // 4))):
            passage[at] = "other"
        docs.append((k, " ".join(body[:20] + passage + body[20:])))
    docs += [(70, ", ".join(prose(8, 60)[10:35]).upper()), (71, " ".join(prose(6, 20)[:19])), (71, " ".join(prose(6, 20)[:19])), *ODD]
    expected = {}
    for d, t in docs:
        for i, b in items:
            if best := best_windows(t if d != 93 else "", b):
                expected[(d, i)] = best
    assert len(expected) > 25
    assert leaks(spark, docs_of, docs, items, broadcast_words=words) == expected


def test_masks_lose_nothing():
    from itertools import combinations

    def fits(masks, size, gone):
        return any(all(o + m not in gone for m in mask) for mask in masks for o in range(size - mask[-1]))

    for masks, sizes in ((decontaminate.LONG_MASKS, range(15, 21)), (decontaminate.SHORT_MASKS, range(8, 15))):
        for size in sizes:
            assert all(fits(masks, size, set(c)) for c in combinations(range(size), int(size * 0.2 + 1e-9)))


def test_leaks_of_empty_tables(spark, docs_of):
    assert leaks(spark, docs_of, [(1, "a b c")], []) == {}
    empty = docs_of((1, "a")).limit(0)
    items = spark.createDataFrame([(1, " ".join(WORDS[:20]))], "item_id long, text string")
    assert decontaminate.contaminated(empty, items).collect() == []


# Line templates


def lines(docs_of, *rows):
    return sorted(
        ((r.doc_id, r.text, list(r.dropped_lines)) for r in line_templates.drop_recurring_lines(docs_of(*rows)).collect()), key=str
    )


def text_of(seed, *extra):
    own = [" ".join(prose(seed * 100 + i, 9)) for i in range(6)]
    return "\n".join([*own[:3], *extra, *own[3:]])


def test_recurring_lines_go_and_copies_stay(docs_of):
    notice = "All rights reserved by {} and others"
    rows = [(i, text_of(i, notice.format(f"year{2000 + i}"), "", "shared passage " + " ".join(WORDS[:60]))) for i in range(4)]
    rows += [(10 + i, text_of(77)) for i in range(5)]  # a text and its copies
    rows += [(20 + i, text_of(78 + i, "seen in two documents only, as it is here")) for i in range(2)]
    found = lines(docs_of, *rows)
    assert found == sorted([(d, text_of(d, ""), [3, 5]) if d < 10 else (d, t, []) for d, t in rows], key=str)


def test_a_word_field_is_generalised(docs_of):
    line = "the session of user {} was closed by the remote host today again"
    rows = [(i, text_of(i, line.format(name))) for i, name in enumerate(["anna", "bert", "carl", "dora"])]
    assert [d for _, _, d in lines(docs_of, *rows)] == [[3]] * 4
    other = "the session of user bert was opened for some local guest now"
    assert [d for _, _, d in lines(docs_of, *rows, (9, text_of(9, other)))][-1] == []


def test_copies_without_long_stretches_stay(docs_of):
    one = prose(61, 30)
    rows = [(i, " ".join([*one[:12], f"edit{i}".replace(str(i), "abc"[i]), *one[13:]])) for i in range(3)]
    rows += [(10 + i, f"invoice number {1000 + i} was sent to the customer by the office on time") for i in range(3)]
    verse = [" ".join(prose(700 + i, 2)) for i in range(12)]
    rows += [(20 + i, "\n".join([*verse[:i], f"own {'abc'[i]}", *verse[i + 1 :]])) for i in range(3)]
    assert lines(docs_of, *rows) == sorted([(d, t, []) for d, t in rows], key=str)


def test_a_recurring_line_goes_from_short_lined_documents(docs_of):
    verse = lambda i: [" ".join(prose(800 + 20 * i + j, 2)) for j in range(12)]
    rows = [(i, "\n".join(["share this", *verse(i)])) for i in range(5)]
    assert [d for _, _, d in lines(docs_of, *rows)] == [[0]] * 5


def test_lines_of_odd_rows(docs_of):
    rows = [*ODD, (96, "x" * 300_000 + " 1 " + "y" * 300_000)]
    assert lines(docs_of, *rows) == sorted([(d, t, []) for d, t in rows], key=str)
    assert line_templates.drop_recurring_lines(docs_of((1, "a")).limit(0)).collect() == []


# Language


def test_languages_by_cross_parsing(docs_of):
    kinds = {"aa": "bado kite lumo sane", "bb": "grumpf zwork trallig schnok", "cc": "été ñandú çava où"}
    r = random.Random(1)
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join(r.choices(kinds[lang].split(), k=r.randrange(2, 60))).capitalize(), lang))
    learn = docs_of(*rows[:120], (500, None, "aa"), (501, "text", None), (502, "", "bb"))
    found = cross_parsing.identify(docs_of(*rows[120:], *ODD, (95, "123 ... 456")), learn).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert sum(got[i][0] == lang for i, _, lang in rows[120:]) >= 118
    assert all(got[i] == ("und", 0.0) for i in (90, 91, 92, 95)) and got[94][0] != "und"
    assert all(0 <= s <= 1 for _, s in got.values()) and len(found) == 120 + len(ODD) + 1
    assert {r.lang_pred for r in cross_parsing.identify(docs_of(*rows[:9]), learn.limit(0)).collect()} == {"und"}


def test_parsing_matches_the_plain_method():
    pieces = {"x": ["abracadabra", "banana cab"], "y": ["zigzag baobab"]}
    model = cross_parsing.learn_model(pieces)

    def plain(sample, text):
        count, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and any(text[at : at + size + 1] in s for s in sample):
                size += 1
            count, at = count + 1, at + size
        return count

    r = random.Random(3)
    texts = ["".join(r.choices("abcrdngzioq ", k=r.randrange(1, 60))).strip() or "a" for _ in range(200)]
    texts = [re.sub(" +", " ", t) for t in texts]
    symbols, sizes = cross_parsing.symbols_of(texts, model["symbols"])
    windows = np.split(symbols, np.cumsum(sizes)[:-1])
    got = cross_parsing.phrases(model, windows)
    assert got.tolist() == [[plain(pieces["x"], t), plain(pieces["y"], t)] for t in texts]


# Near duplicates


def test_near_copies_match_brute_force(docs_of):
    r = random.Random(5)
    rows = []
    for k in range(25):
        base = prose(k, r.randrange(1, 120))
        for _ in range(r.randrange(1, 5)):
            body = list(base)
            for at in r.sample(range(len(body)), len(body) // 25):
                body[at] = r.choice(["swapped", "changed"])
            rows.append((len(rows), " ".join(body).title() if r.random() < 0.3 else " ".join(body)))
    rows += [(500 + i, " ".join(prose(99, 80))) for i in range(6)]
    split = [order_minhash.word_list(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            close = split[a] == split[b] or (min(len(split[a]), len(split[b])) >= 5 and order_minhash.similar(split[a], split[b]))
            if close and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    expected = {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}
    found = order_minhash.near_duplicates(docs_of(*rows)).collect()
    assert {r.doc_id: r.cluster_id for r in found} == expected
    assert all(r.kept == (r.doc_id == r.cluster_id) for r in found)


def groups_by_entries(docs, entries):
    """The groups by links between all documents that share an entry."""
    rows = order_minhash.fingerprints(docs, "doc_id", "text", entries).collect()
    words = {r.doc_id: order_minhash.word_list(r.text) for r in docs.collect()}
    root = {r.doc_id: r.doc_id for r in rows}
    for a in rows:
        for b in rows:
            if a.doc_id < b.doc_id and set(a.entries) & set(b.entries) and order_minhash.similar(words[a.doc_id], words[b.doc_id]):
                old, new = max(root[a.doc_id], root[b.doc_id]), min(root[a.doc_id], root[b.doc_id])
                root = {d: new if x == old else x for d, x in root.items()}
    return root


def test_spokes_meet_their_hub(docs_of):
    base, r = prose(41, 200), random.Random(12)
    rows = [(20, " ".join(base))]
    for i in [*range(20), *range(21, 41)]:
        body = list(base)
        for at in r.sample(range(200), 24):
            body[at] = f"new{i}x{at}"
        rows.append((i, " ".join(body)))
    expected = groups_by_entries(docs_of(*rows), order_minhash.ENTRIES)
    assert sum(c == expected[20] for c in expected.values()) > 30
    assert {r.doc_id: r.cluster_id for r in order_minhash.near_duplicates(docs_of(*rows)).collect()} == expected


def test_all_groups_of_a_shared_passage_are_found(docs_of):
    passage, rows = prose(43, 90), []
    for k in range(20):
        own = [f"own{k}x{i}" for i in range(60)]
        rows += [(k, " ".join(own + passage)), (100 + k, " ".join(own[:58] + ["else", f"other{k}"] + passage))]
        rows.append((200 + k, " ".join([f"alone{k}x{i}" for i in range(60)] + passage)))
    expected = groups_by_entries(docs_of(*rows), 1)
    assert sum(d - c == 100 for d, c in expected.items()) > 15
    assert {r.doc_id: r.cluster_id for r in order_minhash.near_duplicates(docs_of(*rows), entries=1).collect()} == expected


def test_bags_rule_no_close_pair_out():
    r, hashes = random.Random(8), order_minhash.WordHashes()
    for _ in range(300):
        a = prose(r.randrange(99), r.randrange(5, 400))
        b = [w for w in a if r.random() > 0.1] + prose(r.randrange(99), r.randrange(9))
        x, y = order_minhash.bags(*hashes([" ".join(a), " ".join(b)])).astype(int)
        edits = order_minhash.banded_distance(a, b, 500)
        assert max(np.maximum(x - y, 0).sum(), np.maximum(y - x, 0).sum(), abs(len(a) - len(b))) <= edits


def test_words_of_a_slice_of_texts_are_held_at_a_time(spark, docs_of, monkeypatch):
    docs, tasks = docs_of((1, "a")), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: tasks.append(work) or spark.createDataFrame([], schema))
    monkeypatch.setattr(order_minhash.bitmaps, "collected", lambda *a: None)
    monkeypatch.setattr(order_minhash.bitmaps, "held", lambda bitmap, places: places % 2 == 0)
    order_minhash.fingerprints(docs, "doc_id", "text")
    order_minhash.word_sequences(docs, "doc_id", "text", docs.select("doc_id").toDF("id"))
    texts = [None, "", *[" ".join(prose(i, 1500)) for i in range(900)], None]
    rows = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": pa.array(texts, pa.string()), "place": list(range(len(texts)))})
    hashes, found = order_minhash.WordHashes(), []
    for work in tasks:
        tracemalloc.start()
        found.append(pa.Table.from_batches(work(iter([rows]))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000
    assert found[0].column("doc_id").to_pylist() == list(range(2, 902))
    assert found[0].column("h1")[899].as_py() == order_minhash.sketch(*hashes([texts[901]]))[0].astype(np.int64)[0, 0]
    assert found[1].column("id").to_pylist() == list(range(0, 903, 2))
    assert found[1].column("words").to_pylist() == [hashes([t])[0].tobytes() for t in texts[::2]]


def test_near_copies_of_odd_rows(docs_of):
    found = order_minhash.near_duplicates(docs_of(*ODD, (95, "ONE!"))).collect()
    assert Counter((r.doc_id, r.cluster_id) for r in found) == Counter(
        [(90, 90), (91, 91), (92, 92), (None, None), (93, 93), (94, 94), (94, 94), (95, 94)]
    )
    assert order_minhash.near_duplicates(docs_of((1, "a")).limit(0)).collect() == []


def test_banded_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(2)
    for _ in range(3000):
        a, b = ([r.randrange(3) for _ in range(r.randrange(12))] for _ in range(2))
        k, d = r.randrange(8), plain(a, b)
        assert order_minhash.banded_distance(a, b, k) == (d if d <= k else None)


# Tokens

PATH = public_tokenizers.path(queries.VOCABULARY)


def test_tokens_are_those_of_the_library(spark, docs_of):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=duckdb_bpe.load_vocabulary(PATH), special_tokens={}
    )
    r = random.Random(8)
    alphabet = "ab é½中🙂'\n\t\x1c\x85  .,!s0Ⅷ"
    rows = [(i, "".join(r.choices(alphabet, k=r.randrange(40)))) for i in range(300)]
    rows += [(400, "I'll don't  <|endoftext|> naïve"), (401, "ab" * 4000 + " " + "é!" * 300), *ODD]
    want = {(i, t): library.encode_ordinary(t or "") for i, t in rows}
    both = queries.token_ids(docs_of(*rows)).collect()
    assert len(both) == len(rows)
    for row in both:
        assert list(row.token_ids) == want[(row.doc_id, row.text)] and bytes(row.decoded) == (row.text or "").encode()
    ids = duckdb_bpe.encode(docs_of(*rows), PATH, public_tokenizers.PATTERN)
    apart = duckdb_bpe.decode(ids, PATH, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in apart)
    assert queries.token_ids(docs_of((1, "a")).limit(0)).collect() == []
    nothing = spark.createDataFrame([(None,), ([],), ([65, 66],)], "token_ids array<int>")
    assert len(duckdb_bpe.decode(nothing, PATH, public_tokenizers.PATTERN).collect()) == 3


def test_unknown_ids_fail():
    codec = duckdb_bpe.Codec(duckdb_bpe.shared_parts(PATH, public_tokenizers.PATTERN))
    with pytest.raises(ValueError):
        codec.decode([np.array([10**6], np.int32)])


def test_common_words_stay_known_within_the_bound(monkeypatch):
    monkeypatch.setattr(duckdb_bpe, "KNOWN_BYTES", 80_000)
    codec = duckdb_bpe.Codec(duckdb_bpe.shared_parts(PATH, public_tokenizers.PATTERN) | {"name": "common words"})
    r, queried, learn = random.Random(3), [], codec.learn_words
    monkeypatch.setattr(codec, "learn_words", lambda words: (queried.extend(words), learn(words)))
    word = lambda: " " + "".join(r.choices("bcdfgjkqvxz", k=12))
    common = [word() for _ in range(20)]
    for _ in range(12):
        text = "".join(common + [word() for _ in range(100)])
        assert codec.decode(codec.encode([text, None])) == [text.encode(), b""]
        held = [*codec.encoded.items(), *codec.older.items()]
        assert sum(len(w) + len(ids) + 150 for w, ids in held) < 80_000 + 120 * 300
    assert len(queried) > 1200 and all(queried.count(w) == 1 for w in common)


def _codec(name):
    return duckdb_bpe.Codec(duckdb_bpe.shared_parts(PATH, public_tokenizers.PATTERN) | {"name": name})


def test_matches_of_one_text_at_a_time_are_held():
    codec, texts = _codec("one text"), [" zqx vkj" * 10_000] * 30
    codec.encode(texts[:1])
    tracemalloc.start()
    found = codec.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(ids, found[0]) for ids in found) and codec.decode(found[:1]) == [texts[0].encode()]
    assert peak < 4 * sum(map(len, found)) + 20_000_000


def test_a_word_is_looked_up_once_for_all_its_matches():
    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    codec = _codec("looked up once")
    codec.encode([" zqx vkj"])
    codec.encoded = Counted(codec.encoded)
    assert codec.decode(codec.encode([" zqx vkj" * 500, " vkj"])) == [b" zqx vkj" * 500, b" vkj"]
    assert codec.encoded.asked <= 4


def test_a_task_gives_memory_back_once_its_own_is_gone(monkeypatch):
    own, gone = [], []

    def work(batches):
        rows = {"held"}
        own.append(weakref.ref(rows))
        yield from batches
        assert rows

    monkeypatch.setattr(duckdb_bpe.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: gone.append(own[0]() is None)))
    assert list(duckdb_bpe._giving_back(work)(iter([1, 2]))) == [1, 2]
    assert gone == [True]
    assert duckdb_bpe.KNOWN_BYTES <= 100 << 20


def test_known_words_go_with_what_tasks_share():
    parts = duckdb_bpe.shared_parts(PATH, public_tokenizers.PATTERN)
    ids = duckdb_bpe.Codec(parts).encode([" zqxvkjw"])
    known = duckdb_bpe.Codec(parts)
    assert " zqxvkjw" in known.encoded and np.array_equal(known.encode([" zqxvkjw"]), ids)
    assert not duckdb_bpe.Codec(duckdb_bpe.shared_parts(PATH, public_tokenizers.PATTERN)).encoded


def test_decoding_in_several_queries(monkeypatch):
    monkeypatch.setattr(duckdb_bpe, "QUERY_IDS", 7)
    codec, r = _codec("several queries"), random.Random(5)
    for texts in ([None, ""], [""], ["".join(r.choices("ab é中🙂\n", k=r.randrange(60))) for _ in range(40)] + ["", "ab " * 30]):
        assert codec.decode(codec.encode(texts)) == [(t or "").encode() for t in texts]


# Toxicity


def test_scores_of_words_are_held_within_a_bound():
    scores = toxic_segments._Scores({"word7": 2.0, "oth9*": 1.0}, 0.5)
    for _ in range(2):
        assert toxic_segments.score_tokens([f"word{i}" for i in range(150_000)], scores)[6:9] == [-0.5, 1.5, -0.5]
        assert len(scores) <= 100_000
    assert scores["oth9x"] == 0.5


def test_maximal_segments_match_their_definition():
    def plain(scores, low, high):
        """The heaviest segment, then the same on both sides of it."""
        best, at = 0, None
        for i in range(low, high):
            total = 0
            for j in range(i, high):
                total += scores[j]
                if total > best + 1e-9:
                    best, at = total, (i, j + 1)
        return [] if at is None else plain(scores, low, at[0]) + [(*at, best)] + plain(scores, at[1], high)

    r = random.Random(4)
    for _ in range(300):
        scores = [r.uniform(-2, 1.5) for _ in range(r.randrange(25))]
        got = toxic_segments.maximal_segments(scores)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in plain(scores, 0, len(scores))]


def test_toxic_documents_are_told_apart(spark, docs_of):
    r, bad = random.Random(6), ["vile", "nastyone", "nastytwo", "nastythree"]
    rows, labels = [], []
    for i in range(600):
        body, toxic = prose(i, r.randrange(10, 90)), int(i % 5 == 0)
        for _ in range(3 * toxic):
            body.insert(r.randrange(len(body)), r.choice(bad))
        rows.append((i, " ".join(body)))
        labels.append((i, toxic))
    known = spark.createDataFrame([*labels[:400], (401, None), (None, 1), (7000, 1)], "doc_id long, toxic int")
    found = toxic_segments.score_toxicity(docs_of(*rows, *ODD), docs_of(*rows[:410], *ODD), known).collect()
    got = {r.doc_id: r for r in found}
    right = sum((got[i].toxicity >= 0.7) == bool(t) for i, t in labels[400:])
    assert right >= 196 and len(found) == 600 + len(ODD)
    assert all(0 <= r.toxicity <= 1 for r in found) and got[91].toxicity < 0.7 and got[90].toxicity == got[91].toxicity
    hit = got[500]
    assert hit.toxic_passages and any(b in hit.text[p.start : p.end] for p in hit.toxic_passages for b in bad)
    alike = toxic_segments.score_toxicity(docs_of(*ODD), docs_of(*rows[:5]), known.limit(0)).collect()
    assert len({r.toxicity for r in alike}) <= 5


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and pii_crf.luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(9)
    for alphabet in ("a@.b ", "1. 2+", "12 -3+(", "a@b.c-1.2+ é🙂"):
        for _ in range(3000):
            text = "".join(r.choices(alphabet, k=r.randrange(50)))
            want = [(i, *m.span()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if passes(k, m[0])]
            assert pii_crf.base_spans(text) == want, text
    assert pii_crf.base_spans("4111 1111 1111 1111")[0][0] == 2
    weights = pii_crf.learn_weights(np.zeros(0, np.int64), np.zeros((0, 11), np.int64), np.zeros((0, 3), np.int64))
    odd = ["1.2.3.²", "٣.٣.٣.٣ 1", "1" * 50_000, "@" * 5000 + "1", "a" * 100_000 + "@", "+" + "1 " * 20_000, None]
    assert len(pii_crf.find_spans(odd, weights)) == len(odd)


def test_cards_side_by_side_are_added(docs_of):
    r = random.Random(10)

    def card():
        body = "".join(r.choices("123456789", k=15))
        return next(body + c for c in "0123456789" if pii_crf.luhn(body + c))

    rows = [(1000 + i, f"{' '.join(prose(i, 9))} {card()} {' '.join(prose(i, 5))} room {i}") for i in range(150)]
    one, two = card(), card()
    text = f"both {one} {two} here"
    rows += [(200, text), (201, text), *ODD]
    got = {r.doc_id: r.pii for r in pii_crf.personal_data(docs_of(*rows)).collect()}
    spans = [(s.kind, text[s.start : s.end], s.base) for s in got[200]]
    assert spans == [("card", one, False), ("card", two, False)] and got[200] == got[201]
    assert all(len(got[i]) == 1 and got[i][0].base for i in range(1000, 1150))
    assert got[90] == got[91] == got[92] == []
    assert pii_crf.personal_data(docs_of((1, "a")).limit(0)).collect() == []


def test_skip_edges_carry_labels():
    weights = pii_crf.learn_weights(np.zeros(0, np.int64), np.zeros((0, 11), np.int64), np.zeros((0, 3), np.int64))
    graph = pii_crf.Graph()
    text = "call +1 (017) 555-7713 or, " + "word " * 40 + "again 0175557713 x7"
    graph.add(0, text, pii_crf.base_spans(text))
    p = pii_crf.infer(*graph.arrays(), weights)
    assert p[1].argmax() == pii_crf.KINDS.index("phone") and p[2].max() < 0.3


def test_texts_without_blanks_between_words(docs_of):
    r = random.Random(21)
    han = "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(400))
    thai = "".join(chr(0x0E01 + r.randrange(40)) for _ in range(300))
    changed = lambda t, i: t[:i] + ("七" if t is han else "ๆ") + t[i + 1 :]
    rows = [(1, han), (2, changed(han, 200)), (3, han[::-1]), (4, thai), (5, changed(thai, 40) + "。"), (6, "“Quoted” words — and more of them"), (7, "quoted words and more of them")]
    found = {row.doc_id: row.cluster_id for row in order_minhash.near_duplicates(docs_of(*rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}


def test_a_large_bucket_of_unlike_documents(spark, docs_of, monkeypatch):
    """A passage in many unlike texts, some of which have copies: chunks meet each other, and what they return grows no faster than their members."""
    monkeypatch.setattr(order_minhash, "CHUNK_ROWS", 16)
    passage, r = prose(77, 40), random.Random(13)
    rows = []
    for group in range(40):
        own = prose(1000 + group, 30)
        for copy in range(r.choice([1, 1, 2, 3])):
            rows.append((group + 100 * copy, " ".join([w if r.random() > 0.05 else "edit" for w in own[:15] + passage + own[15:]])))
    r.shuffle(rows)
    docs = docs_of(*rows)
    assert {row.doc_id: row.cluster_id for row in order_minhash.near_duplicates(docs).collect()} == groups_by_entries(docs, order_minhash.ENTRIES)


def test_a_large_group_of_near_copies_is_dealt_out_once(docs_of, monkeypatch):
    """What is connected already meets the few others only: its members are not repeated for each of its own chunks."""
    monkeypatch.setattr(order_minhash, "CHUNK_ROWS", 8)
    met, remaining, apply = [], order_minhash._remaining_links, GroupedData.applyInArrow
    monkeypatch.setattr(order_minhash, "_remaining_links", lambda members, *rest: met.append(members.count()) or remaining(members, *rest))
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *how: met.append(self._df.count()) or apply(self, *how))
    base, r = prose(91, 100), random.Random(19)
    rows = [(i, " ".join(w if r.random() > 0.02 else f"edit{i}" for w in base)) for i in range(150)]
    rows += [(150 + i, " ".join(base[:60] + [f"own{i}x{k}" for k in range(40)])) for i in range(6)]
    rows += [(160 + i, " ".join(base[:60] + [f"own{i}x{k}" for k in range(36)] + ["other", f"end{i}"])) for i in range(3)]
    r.shuffle(rows)
    docs = docs_of(*rows)
    expected = groups_by_entries(docs, order_minhash.ENTRIES)
    assert {row.doc_id: row.cluster_id for row in order_minhash.near_duplicates(docs).collect()} == expected
    _, members, dealt = met
    assert members > 300 and dealt < 4 * members
