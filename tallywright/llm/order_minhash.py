"""Near-duplicate documents by order MinHash and banded alignment.

Each document's word k-mers (five words) are labelled by how often they have occurred
before. A sketch entry samples the two labelled k-mers that are least under its hash and
keeps them in the order of the text, so equal entries speak for equal order too: for
similarity of edits, not of bags. Documents that share an entry are candidates. A pair is a
link if a banded alignment of the two word sequences needs edits for at most a fifth of the
longer one, and groups are the connected components of links.

Candidates meet in two steps. First every member of an entry meets the entry's two leaders
(its smallest and largest id), which joins up most groups. Then, in entries whose members
are still in several components, all members of different components meet, in tasks that hold
two chunks of an entry each; a pair that shares several entries meets in the first. The
component that most members of an entry are in is connected already and only meets the others:
its members are dealt out once for each chunk of those others. Such a task aligns what
lengths and counts of words do not rule out, stops comparing members that its links have
connected, and returns a link for each of two components that it has joined: no more rows
than members, and no candidate left out.

Copies with the same words are one class from the start. Sketches of two documents with
a share j of common k-mers agree in an entry with a probability of about j squared; with
20 entries 0.95 of pairs at j = 0.37 are found and 0.999 at j = 0.54. Whole texts are
read once for the sketches and once for the word hashes of documents that have a candidate;
only those hashes are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import bitmaps
from tallywright.llm.common import Batches, giving_back, slices, stored
from tallywright.llm.components import components, jumped, labels, oriented

SHINGLE_WORDS = 5
SIMILARITY = 0.8
ENTRIES = 20
BAG = 256  # counters of words, up to 255 each
CHUNK_ROWS = 1024
JUMPS = 2

_SLICE_BYTES = 1 << 19  # a word takes some 200 bytes while its text is sketched
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Thai, Lao, Tibetan, Burmese, Khmer, kana and Han have no blanks between words: there each character is a word.
_SOLID = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MARK = re.compile("[^\\w\x00-\x7f\u0300-\u036f]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def _prepared(text: str | None) -> bytes:
    """The text in lower case, with blanks around words that have none and for marks outside ASCII."""
    if not text:
        return b""
    text = text.lower()
    if not text.isascii():
        text = _MARK.sub(" ", _SOLID.sub(r" \g<0> ", text))
    return text.encode("utf-8", "replace")


def word_list(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case; single characters in scripts without blanks."""
    return _WORD.findall(_prepared(text))


def _powers(base: np.uint64, size: int) -> np.ndarray:
    found = np.full(size, base)
    found[0] = 1
    return np.cumprod(found, out=found)


class WordHashes:
    """Hashes of the words of many texts at once, from sums of bytes times powers."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        if len(self.powers) < size:
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            self.powers, self.inverse = (_powers(x, size + size // 8) for x in (_ODD, inverse))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes end to end and the number of words of each text."""
        raw = [_prepared(t) for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self._reach(len(data))
        inside = _IS_WORD[data]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(data, self.powers[: len(data)], out=sums[1:])
        np.cumsum(sums, out=sums)
        hashes = _mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(r) + 1 for r in raw])
        return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def _seeds(entries: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(6)
    return tuple(random.integers(1, 1 << 63, entries, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def sketch(words: np.ndarray, sizes: np.ndarray, entries: int = ENTRIES, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(two hashes of the word sequence, sketch entries) of texts that have words each.

    A text of fewer than k words is a single k-mer.
    """
    # Short texts are filled up, so that each has a k-mer.
    full = np.maximum(sizes, k)
    first = np.cumsum(full) - full
    padded = np.zeros(full.sum(), np.uint64)
    within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(first, sizes) + within] = words
    counts = full - k + 1
    starts = np.cumsum(counts) - counts
    at = np.repeat(first - starts, counts) + np.arange(counts.sum())
    kmers = np.zeros(len(at), np.uint64)
    for j in range(k):
        kmers = _mixed(kmers + padded[at + j])
    doc = np.repeat(np.arange(len(sizes)), counts)

    # How often a k-mer has come before in its text.
    key = kmers ^ _mixed(doc.astype(np.uint64) + _ODD)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    run = np.flatnonzero(new)
    times = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    labels = np.empty(len(key), np.uint64)
    labels[order] = times
    labelled = _mixed(kmers + labels * _BASE)

    place = np.arange(1, len(at) + 1, dtype=np.uint64)
    own = place - np.repeat(starts.astype(np.uint64), counts)
    mixed = _mixed(labelled + own * _ODD), _mixed(labelled ^ (own * _BASE))
    sequence = np.stack([np.add.reduceat(m, starts) + sizes.astype(np.uint64) for m in mixed], axis=1)
    result = np.empty((len(sizes), entries), np.uint64)
    for s, (flip, odd) in enumerate(zip(*_seeds(entries), strict=True)):
        value = (labelled ^ flip) * odd
        p1 = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), counts))
        p1 = p1[np.concatenate([[True], doc[p1[1:]] != doc[p1[:-1]]])]
        value[p1] = _TOP
        p2 = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), counts))
        p2 = p2[np.concatenate([[True], doc[p2[1:]] != doc[p2[:-1]]])]  # the only k-mer itself where there is one
        low, high = np.minimum(p1, p2), np.maximum(p1, p2)
        result[:, s] = _mixed(_mixed(labelled[low] + np.uint64(s + 1)) + labelled[high])
    return sequence, result


def bags(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many words of each text fall on each counter."""
    at = np.repeat(np.arange(len(sizes)), sizes) * BAG + (words % np.uint64(BAG)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(sizes) * BAG), 255).astype(np.uint8).reshape(-1, BAG)


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (id, text, ...) in slices: only the texts of one need to be Python's at a time."""
    pa.default_memory_pool().release_unused()  # else what batches before took stays beside the next
    for start, end in slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), _SLICE_BYTES):
        yield batch.slice(start, end - start)


def fingerprints(docs: DataFrame, key: str, text: str, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, h1, h2, entries) of every row that has an id and words."""

    def work(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            for part in _sliced(batch):
                words, sizes = hashes(part.column(1).to_pylist())
                some = np.flatnonzero(sizes)
                if len(some):
                    sequence, found = sketch(words, sizes[some], entries)
                    offsets = pa.array(np.arange(0, (len(some) + 1) * entries, entries, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(some)),
                            pa.array(sequence[:, 0].astype(np.int64)),
                            pa.array(sequence[:, 1].astype(np.int64)),
                            pa.ListArray.from_arrays(offsets, pa.array(found.ravel().astype(np.int64))),
                        ],
                        ["doc_id", "h1", "h2", "entries"],
                    )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    return rows.mapInArrow(giving_back(work), "doc_id long, h1 long, h2 long, entries array<long>")


def word_sequences(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(id, words): the 64-bit hashes of all words, in order, of the documents whose ids are in `wanted`; rows that repeat as one."""
    place = F.xxhash64(F.col(key).cast("long"))
    known = docs.sparkSession.sparkContext.broadcast(bitmaps.collected(wanted.select(F.xxhash64("id").alias("place")), "place"))

    def work(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            for part in _sliced(batch):
                part = part.filter(pa.array(bitmaps.held(known.value, part.column(2).to_numpy().view(np.uint64))))
                if part.num_rows:
                    words, sizes = hashes(part.column(1).to_pylist())
                    ends = np.cumsum(sizes)
                    rows = [words[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["id", "words"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), place.alias("place")).filter(F.col("id").isNotNull())
    found = rows.mapInArrow(giving_back(work), "id long, words binary").filter(F.length("words") > 0).join(wanted, "id", "left_semi")
    return found.groupBy("id", F.xxhash64("words").alias("same")).agg(F.first("words").alias("words")).select("id", "words")


def banded_distance(a: list, b: list, most: int) -> int | None:
    """Edits from a to b if they are at most `most`, else None: bit-parallel, over the diagonals within `most`."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    m, n = len(a), len(b)
    if not n:
        return m if m <= most else None
    k = min(most, m)
    if k == 0:
        return None
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask = (1 << (2 * k + 1)) - 1
    plus, minus, edits = mask & ~((1 << k) - 1), 0, k
    diagonal, row = 1 << 2 * k, 1 << 2 * k
    for i, x in enumerate(b):
        bits = places.get(x, 0)
        bits = (bits >> (i - k) if i >= k else bits << (k - i)) & mask
        d0 = ((((bits & plus) + plus) ^ plus) | bits | minus) & mask
        up = minus | (mask & ~(d0 | plus))
        down = d0 & plus
        if i < m - k:
            edits += not d0 & diagonal
            if edits > k + n - (m - k):
                return None
        else:
            row >>= 1
            edits += bool(up & row) - bool(down & row)
        plus = down | (mask & ~((d0 >> 1) | up))
        minus = (d0 >> 1) & up
    return edits if edits <= most else None


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment edits at most 1 - similarity of the longer sequence."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return banded_distance(a, b, most) is not None


def _members(rows: DataFrame) -> DataFrame:
    """(entry, id, n, low, high): the members of entries that several ids share, with their number and the leaders."""
    leaders = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = stored(leaders.filter("low < high"), "shared-entries")
    # Most entries have one member; a bitmap of the others spares the second shuffle their rows.
    likely = bitmaps.perhaps_in(rows, "entry", bitmaps.parts(shared, "entry"), "likely").filter("likely").drop("likely")
    return stored(likely.join(shared.hint("merge"), "entry"), "bucket-members")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """(leader, id): every member of an entry with the entry's smallest and its largest id, once."""
    low = members.filter("id > low").select(F.col("low").alias("leader"), "id")
    high = members.filter("id < high AND id > low").select(F.col("high").alias("leader"), "id")
    return low.union(high).distinct()


def _leader_links(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs (leader, id) that align. A leader's words are written once for every chunk of its members."""
    chunks = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
    fan = stored(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")), "leaders")
    members = pairs.join(fan.hint("merge"), "leader").select("leader", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), "id")
    leaders = fan.select("leader", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.col("leader").alias("id"))

    def align(rows: pa.Table) -> pa.Table:
        ids, leader = rows.column("id").to_pylist(), rows.column("leader")[0].as_py()
        lists = [np.frombuffer(w, np.int64).tolist() for w in rows.column("words").to_pylist()]
        heads = [words for i, words in zip(ids, lists, strict=True) if i == leader]
        linked = {i for i, words in zip(ids, lists, strict=True) if i != leader and any(similar(h, words, similarity) for h in heads)}
        return pa.table({"a": pa.array([leader] * len(linked), pa.int64()), "b": pa.array(sorted(linked), pa.int64())})

    met = members.union(leaders).join(words, "id").select("leader", "chunk", "id", "words")
    return met.groupBy("leader", "chunk").applyInArrow(align, "a long, b long")


def _unconnected(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(entry, id, component, n, bulk, bulk_n): the members of entries whose members are in several components.

    n is the number of an entry's members, bulk the component that most of them are in, bulk_n their number. In entries of
    up to three members all pairs have met their leaders.
    """
    component = F.coalesce("component", "id").alias("component")
    named = stored(
        members.filter("n > 3").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("entry", "id", component),
        "named-members",
    )
    sizes = named.groupBy("entry", "component").agg(F.count(F.lit(1)).alias("size"))
    reach = sizes.groupBy("entry").agg(F.sum("size").alias("n"), F.max(F.struct("size", "component")).alias("bulk"))
    several = reach.filter("bulk.size < n").select("entry", "n", F.col("bulk.component").alias("bulk"), F.col("bulk.size").alias("bulk_n"))
    return named.join(several, "entry")


def _dealt(members: DataFrame) -> DataFrame:
    """`members` of `_unconnected` with chunk, left and right: a row for each pair of chunks that a member's chunk is in.

    The bulk of an entry is connected, so its chunks meet those of the other members only, and the others' chunks come
    first. The bulk is no chunk of its own where that would make more rows.
    """
    chunks = lambda n: F.ceil(n / CHUNK_ROWS).cast("int")
    n, bulk_n = F.col("n"), F.col("bulk_n")
    others, bulks = chunks(n - bulk_n), chunks(bulk_n)
    apart = bulk_n * others + (n - bulk_n) * (others + bulks) < n * chunks(n)
    first, second = F.when(apart, others).otherwise(chunks(n)), F.when(apart, bulks).otherwise(0)
    in_bulk = apart & (F.col("component") == F.col("bulk"))
    of = lambda count: F.pmod(F.xxhash64("id"), F.greatest(count, F.lit(1))).cast("int")
    return (
        members.withColumn("chunk", F.when(in_bulk, first + of(second)).otherwise(of(first)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_bulk, first - 1).otherwise(first + second - 1))))
        .withColumns({"left": F.least("chunk", "other"), "right": F.greatest("chunk", "other")})
        .drop("other", "n", "bulk", "bulk_n")
    )


def _remaining_links(members: DataFrame, classes: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b): components that a link between members of an entry joins; at most one row a member of a task.

    All members of different components meet. An edit changes the length by one at most, and
    adds and takes one word at most, which rules most pairs out. Entries of many members are
    dealt out as pairs of chunks, a task for each.
    """
    known = classes.select("id", "entries").join(words, "id")
    dealt = _dealt(members.join(known.hint("merge"), "id"))

    def meet(rows: pa.Table) -> pa.Table:
        entry, left = rows.column("entry")[0].as_py(), rows.column("left")[0].as_py()
        cross = rows.column("right")[0].as_py() != left
        entries = rows.column("entries").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        held = np.flatnonzero((entries == entry).any(axis=1))  # an id that repeats may come with entries of another text
        entries = entries[held]
        ids, component, chunk = (rows.column(c).to_numpy()[held] for c in ("id", "component", "chunk"))
        raw = [np.frombuffer(w, np.uint64) for w in rows.column("words").take(pa.array(held)).to_pylist()]
        size = np.array([len(w) for w in raw])
        bag = bags(np.concatenate([np.zeros(0, np.uint64), *raw]), size).astype(np.int16)
        component, slot = component.copy(), (entries[:1] == entry).argmax() if len(held) else 0
        a, b = [], []
        order = np.arange(len(ids))
        for i in np.flatnonzero(chunk == left) if cross else order:
            at = order[(chunk != left) if cross else (order > i)]
            at = at[component[at] != component[i]]
            most = ((1 - similarity) * np.maximum(size[at], size[i]) + 1e-9).astype(np.int64)
            able = (np.abs(size[at] - size[i]) <= most) & ((entries[at] == entries[i]).argmax(axis=1) == slot)
            at, most = at[able], most[able]
            change = bag[at] - bag[i]
            more = np.maximum(change, 0).sum(axis=1, dtype=np.int64)
            less = more - change.sum(axis=1, dtype=np.int64)
            for j in at[np.maximum(more, less) <= most]:
                if component[j] != component[i] and similar(raw[i].tolist(), raw[j].tolist(), similarity):
                    old, new = max(component[i], component[j]), min(component[i], component[j])
                    a.append(new)
                    b.append(old)
                    component[component == old] = new
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("entry", "left", "right").applyInArrow(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, entries: int = ENTRIES
) -> DataFrame:
    """(doc_id, class_id, cluster_id, kept) of every row of `docs`.

    class_id is the smallest id with the same words, cluster_id the smallest id reachable by
    links; the document of that id is kept. Rows without words (null, empty, punctuation only)
    or without an id link with nothing. Rows that repeat an id are one document. Texts of fewer
    than five words link only if their words are the same or they meet in a longer chain of
    links. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, key, text, entries), "fingerprints")
    classes = stored(
        prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("entries").alias("entries")), "word-classes"
    )
    members = _members(classes.select("id", F.explode("entries").alias("entry")))
    pairs = stored(_leader_pairs(members), "leader-pairs")
    wanted = stored(pairs.select(F.explode(F.array("leader", "id")).alias("id")).distinct(), "candidate-ids")
    words = stored(word_sequences(docs, key, text, wanted), "candidate-words")
    edges = stored(oriented(_leader_links(pairs, words, similarity)), "leader-links")
    # Labels by a few steps along links connect nearly all that is connected, which spares most comparisons.
    found = labels(edges)
    for _ in range(JUMPS):
        found = stored(jumped(stored(found, "leader-labels")), "leader-labels")
    apart = stored(_unconnected(members, found), "unconnected-members")
    # What is left to connect are labels: by links of the first step between labels, and by those of the second.
    label = lambda end, name: found.select(F.col("node").alias(end), F.col("component").alias(name)).hint("merge")
    between = edges.join(label("u", "a"), "u").join(label("v", "b"), "v").select("a", "b")
    whole = components(between.filter("a <> b").distinct().union(_remaining_links(apart, classes, words, similarity)))
    named = found.join(whole.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    groups = named.select("node", F.coalesce("whole", "component").alias("component"))
    alone = whole.join(found.select("node"), "node", "left_anti").select("node", "component")
    groups = groups.union(alone)

    same = prints.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", F.col("id").alias("class_id")), ["h1", "h2"])
    # An id that several rows carry belongs to the smallest group that any of them reaches.
    named = (
        same.join(groups.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
        .groupBy("doc_id")
        .agg(F.min("class_id").alias("class_id"), F.min(F.coalesce("component", "class_id")).alias("cluster_id"))
    )
    ids = docs.select(F.col(key).cast("long").alias("doc_id"))
    cluster = F.coalesce("cluster_id", "doc_id")
    return ids.join(named, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        cluster.alias("cluster_id"),
        F.col("doc_id").eqNullSafe(cluster).alias("kept"),
    )
