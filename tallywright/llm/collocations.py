"""Frequent phrases and their collocation scores, by Rabin-Karp fingerprints.

Texts become bytes in which words stand one blank apart and pieces one line apart; the
fingerprint of a run of words is then the difference of two prefix sums of a polynomial
over these bytes. Tasks count equal fingerprints, the shuffle adds the counts up, each with
a pointer to a document that holds the phrase; no phrase is written out before it is known
to be frequent.

A phrase is at most as frequent as its parts. So words are counted first, then pairs of
frequent words, then longer runs of frequent pairs. Which fingerprints are frequent reaches
the tasks as a bitmap of fixed size: where it is too small for a corpus, more phrases are
counted than need be, and the result is the same.

Fingerprints are checked against text. Every occurrence adds a second, independent hash to
its fingerprint's count; the document that the pointer names gives the phrase, whose own
hash times the count must be that sum. Where it is not, different phrases have met in one
fingerprint, and their occurrences are counted again by their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm import bitmaps
from tallywright.llm.common import stored

MOST_WORDS = 5
FINGERPRINT_BITS = 64

_SLICE_BYTES = 2 << 20
_HELD_ROWS = 1 << 20
_SUM_BITS = 16  # times a count of up to 2**47 fits 63 bits
_POINTER_BITS = 32  # documents that share a pointer are all looked through; every byte of it is shuffled with each phrase
_TOP_SALTS = 64
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 break
_KIND[list(_BLANKS)], _KIND[list(_BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Odd numbers: the base of the polynomial and the multipliers that scramble its bits.
_BASE, _ODD, _CHECK = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


def _mixed(x: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * odd
    x = (x ^ (x >> np.uint64(27))) * _BASE
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, size: int) -> None:
        if len(self.up) <= size:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * size, b)])) for b in (_BASE, inverse))


class Words:
    """The words of some texts, end to end, and fingerprints of runs of them.

    `first` tells for each text its first word, `run[i]` how many words its piece has from word i on.
    """

    def __init__(self, texts: list[bytes], powers: Powers):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        after = np.concatenate([[False], inside[:-1]])
        opens = np.flatnonzero(inside & ~after)
        # A word is followed by a blank where another word of its piece comes next, else by a line end.
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        piece = breaks[opens]
        joined = np.concatenate([piece[1:] == piece[:-1], [False]]) if len(opens) else np.zeros(0, bool)
        keep = inside | (after & ~inside)
        self.data = _LOWER[raw[keep]]
        ends = np.flatnonzero(~inside[keep])
        self.data[ends] = np.where(joined, 32, 10)
        self.end = ends
        self.start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        last = np.flatnonzero(~joined)
        self.run = (last[np.searchsorted(last, np.arange(len(ends)))] - np.arange(len(ends)) + 1) if len(ends) else ends
        sizes = np.array([len(t) + 1 for t in texts])
        self.first = np.searchsorted(opens, np.cumsum(sizes) - sizes)
        powers.reach(len(self.data))
        self.powers = powers
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data + np.uint64(1)) * powers.up[: len(self.data)])])

    def __len__(self) -> int:
        return len(self.end)

    def polynomial(self, at: np.ndarray, n: int) -> np.ndarray:
        """The polynomials of the runs of n words from the words `at` on."""
        start, end = self.start[at], self.end[at + n - 1]
        return (self.sums[end] - self.sums[start]) * self.powers.down[start] + (end - start).astype(np.uint64) * _ODD

    def phrase(self, at: int, n: int) -> str:
        return self.data[self.start[at] : self.end[at + n - 1]].tobytes().decode("utf-8", "replace")


def fingerprints(polynomials: np.ndarray, language: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, check) of phrases in languages given by their hashes."""
    both = polynomials + _mixed(language, _CHECK)
    found = _mixed(both, _ODD)
    if bits < 64:
        found = _mixed(found >> np.uint64(64 - bits), _ODD)
    return found, _mixed(both, _CHECK) >> np.uint64(64 - _SUM_BITS)


def _sliced(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(row of each text, texts) in slices of bounded size; a longer text is cut between pieces, which no phrase spans."""
    rows, part, held = [], [], 0
    for row, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        text = text or b""
        while text:
            cut = len(text)
            if cut > _SLICE_BYTES:
                near = [text.rfind(bytes([b]), 0, _SLICE_BYTES) for b in _BREAKS]
                far = [x for x in (text.find(bytes([b]), _SLICE_BYTES) for b in _BREAKS) if x >= 0]
                cut = max(near) + 1 if max(near) >= 0 else min(far) + 1 if far else cut
            if part and held + cut > _SLICE_BYTES:
                yield np.array(rows), part
                rows, part, held = [], [], 0
            rows.append(row)
            part.append(text[:cut])
            held += cut
            text = text[cut:]
    if part:
        yield np.array(rows), part


class _Counts:
    """Adds up (n, fingerprint, count, sum of checks, least pointer) within a task."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, n: np.ndarray, found: np.ndarray, count: np.ndarray, check: np.ndarray, pointer: np.ndarray) -> None:
        self.parts.append((n, found, count, check, pointer))
        self._combine(self.parts.pop())

    def _combine(self, new: tuple) -> None:
        n, found, count, check, pointer = new
        order = np.lexsort((n, found)) if n.min(initial=0) != n.max(initial=0) else np.argsort(found, kind="stable")
        n, found, count, check, pointer = (x[order] for x in (n, found, count, check, pointer))
        starts = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (n[1:] != n[:-1])])) if len(found) else np.zeros(0, int)
        if len(starts):
            self.parts.append(
                (n[starts], found[starts], np.add.reduceat(count, starts), np.add.reduceat(check, starts), np.minimum.reduceat(pointer, starts))
            )
            self.held += len(starts)

    def rows(self, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        """The rows so far where they are many, or in the end."""
        if not self.parts or not (all_of_it or self.held > _HELD_ROWS):
            return
        whole = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        self._combine(whole)
        if not all_of_it and self.held <= _HELD_ROWS // 2:
            return  # many were equal: they stay
        (n, found, count, check, pointer), = self.parts
        self.parts, self.held = [], 0
        for at in range(0, len(n), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(n[cut].astype(np.int8)), pa.array(found[cut].view(np.int64)), pa.array(count[cut]), pa.array(check[cut]), pa.array(pointer[cut])],
                ["n", "fingerprint", "a", "checks", "pointer"],
            )


def _counted(texts: DataFrame, runs: Callable[[Words, Callable], Iterator[tuple[int, np.ndarray]]], bits: int) -> DataFrame:
    """(n, fingerprint, a, checks, pointer): counts of the runs of words that `runs` picks, as (n, first words), from a slice.

    `runs` gets the words and a function that gives the fingerprints of runs of n words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = Powers(), _Counts()
        for batch in batches:
            languages, pointers = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            for rows, part in _sliced(batch.column(0)):
                words = Words(part, powers)
                if not len(words):
                    continue
                row = np.repeat(rows, np.diff(np.append(words.first, len(words))))
                language = languages[row]
                prints = lambda at, n: fingerprints(words.polynomial(at, n), language[at], bits)  # noqa: B023, E731
                for n, at in runs(words, prints):
                    found, check = prints(at, n) if n else (language[at], np.zeros(len(at), np.uint64))
                    counts.add(np.full(len(at), n), found, np.ones(len(at), np.int64), check.astype(np.int64), pointers[row[at]])
                    yield from counts.rows(False)
        yield from counts.rows(True)

    rows = texts.select("text", "language", "pointer").mapInArrow(work, "n byte, fingerprint long, a long, checks long, pointer long")
    return rows.groupBy("n", "fingerprint").agg(
        F.sum("a").alias("a"), F.sum("checks").alias("checks"), F.min("pointer").alias("pointer")
    )


def _words_only(words: Words, prints: Callable) -> Iterator[tuple[int, np.ndarray]]:
    """All words, and all of them once more as 0 words, by which a language's words are counted."""
    every = np.arange(len(words))
    yield 0, every
    yield 1, every


def _frequent_pairs(known_words) -> Callable:
    def runs(words: Words, prints: Callable) -> Iterator[tuple[int, np.ndarray]]:
        every = np.arange(len(words))
        good = bitmaps.held(known_words.value, prints(every, 1)[0])
        yield 2, np.flatnonzero((words.run >= 2) & good & np.append(good[1:], False))

    return runs


def _longer(known_pairs) -> Callable:
    def runs(words: Words, prints: Callable) -> Iterator[tuple[int, np.ndarray]]:
        at = np.flatnonzero(words.run >= 2)
        good = np.zeros(len(words) + 1, bool)
        good[at] = bitmaps.held(known_pairs.value, prints(at, 2)[0])
        for n in range(3, MOST_WORDS + 1):
            # Pairs from words i to i + n - 2; a pair within its piece tells that the piece goes on.
            at = np.flatnonzero(good)
            at = at[words.run[at] >= n]
            for j in range(1, n - 1):
                at = at[good[at + j]]
            yield n, at

    return runs


def _written_out(texts: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """(n, fingerprint, check, lang, phrase) of frequent fingerprints, from the documents that their pointers name."""
    spark = texts.sparkSession
    wanted = stored(
        frequent.groupBy("pointer").agg(F.collect_list(F.struct("n", "fingerprint")).alias("wanted")), "wanted-phrases"
    )  # at most the runs of words of one document
    known = spark.sparkContext.broadcast(bitmaps.collected(wanted, "pointer"))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmaps.held(known.value, batch.column(2).to_numpy().view(np.uint64))))

    few = texts.mapInArrow(pointed, texts.schema).join(wanted, "pointer").select("text", "language", "pointer", "lang", "wanted")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            languages = batch.column(1).to_numpy().view(np.uint64)
            langs, lists = batch.column(3).to_pylist(), batch.column(4)
            for row in range(batch.num_rows):
                pairs = lists[row].values
                ns, prints = pairs.field("n").to_numpy(), pairs.field("fingerprint").to_numpy().view(np.uint64)
                out = []
                if (ns == 0).any():
                    out.append((0, int(languages[row : row + 1].view(np.int64)[0]), 0, langs[row], ""))
                for _, part in _sliced(batch.column(0).slice(row, 1)):
                    words = Words(part, powers)
                    for n in range(1, MOST_WORDS + 1):
                        asked = prints[ns == n]
                        at = np.flatnonzero(words.run >= n)
                        found, check = fingerprints(words.polynomial(at, n), np.repeat(languages[row], len(at)), bits)
                        hit = np.flatnonzero(np.isin(found, asked))
                        _, one = np.unique(found[hit], return_index=True)
                        for i in hit[one]:
                            out.append((n, int(found[i : i + 1].view(np.int64)[0]), int(check[i]), langs[row], words.phrase(at[i], n)))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int8(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "fingerprint", "check", "lang", "phrase"]
                )

    # A pointer stands for several rows where their hashes agree or they repeat as a whole, and a text may be cut; any will do.
    schema = "n byte, fingerprint long, check long, lang string, phrase string"
    written = few.mapInArrow(write, schema)
    one = F.min(F.struct("check", "lang", "phrase")).alias("one")
    return written.groupBy("n", "fingerprint").agg(one).select("n", "fingerprint", "one.*")


def _recounted(texts: DataFrame, collided: DataFrame, bits: int) -> DataFrame:
    """(n, lang, phrase, a) of all phrases that have a fingerprint in which several phrases met."""
    known = texts.sparkSession.sparkContext.broadcast(bitmaps.collected(collided, "fingerprint"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            languages = batch.column(1).to_numpy().view(np.uint64)
            langs = batch.column(3)
            for rows, part in _sliced(batch.column(0)):
                words = Words(part, powers)
                row = np.repeat(rows, np.diff(np.append(words.first, len(words))))
                for n in range(1, MOST_WORDS + 1):
                    at = np.flatnonzero(words.run >= n)
                    found, _ = fingerprints(words.polynomial(at, n), languages[row[at]], bits)
                    hit = np.flatnonzero(bitmaps.held(known.value, found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(hit), n, np.int8)),
                            pa.array(found[hit].view(np.int64)),
                            langs.take(pa.array(row[at[hit]])),
                            pa.array([words.phrase(i, n) for i in at[hit]], pa.string()),
                        ],
                        ["n", "fingerprint", "lang", "phrase"],
                    )

    found = texts.mapInArrow(write, "n byte, fingerprint long, lang string, phrase string")
    exact = found.join(collided.select("n", "fingerprint"), ["n", "fingerprint"], "left_semi")
    return exact.groupBy("n", "lang", "phrase").agg(F.count(F.lit(1)).alias("a"))


def frequent_phrases(
    docs: DataFrame, least: int, key: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = FINGERPRINT_BITS
) -> DataFrame:
    """(n, lang, phrase, a): phrases of up to five words that occur `least` times in a language or more.

    Rows of 0 words give the number of all word occurrences of each language that has any.
    """
    language = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    texts = docs.select(
        F.col(text).cast("string").alias("text"),
        F.xxhash64(language).alias("language"),
        F.xxhash64(language, F.col(key), F.col(text)).bitwiseAND(F.lit(-1 << (64 - _POINTER_BITS))).alias("pointer"),
        language.alias("lang"),
    )
    context = docs.sparkSession.sparkContext
    enough = F.col("a") >= least
    words = stored(_counted(texts, _words_only, bits).filter(enough | (F.col("n") == 0)), "frequent-words")
    known = context.broadcast(bitmaps.collected(words.filter("n = 1"), "fingerprint"))
    pairs = stored(_counted(texts, _frequent_pairs(known), bits).filter(enough), "frequent-pairs")
    known_pairs = context.broadcast(bitmaps.collected(pairs, "fingerprint"))
    longer = stored(_counted(texts, _longer(known_pairs), bits).filter(enough), "frequent-runs")

    frequent = words.union(pairs).union(longer)
    written = stored(frequent.join(_written_out(texts, frequent, bits), ["n", "fingerprint"]), "written-phrases")
    one_phrase = F.col("check") * F.col("a") == F.col("checks")
    sure = written.filter(one_phrase).select("n", "lang", "phrase", "a")
    collided = stored(written.filter(~one_phrase).select("n", "fingerprint"), "collided-fingerprints")
    if collided.isEmpty():
        return sure
    return sure.union(_recounted(texts, collided, bits).filter(enough).select("n", "lang", "phrase", "a"))


def _cut_scores(phrases: DataFrame, totals: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest-scoring cut of each phrase."""
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("right"),
    )
    part = lambda side, name: parts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    met = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    # `div` of decimals is exact; a quotient is rounded down and fits 64 bits, as l and r are a at least.
    exact = met.withColumns({"over": F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), "under": big("l") * big("r")})
    scored = exact.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r", "n"))
    return scored.groupBy("lang", "phrase", "a").agg(best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.n", "b.score")


def _not_absorbed(phrases: DataFrame, percent: int) -> DataFrame:
    """`phrases` without those that some longer one holds with `percent` of their count or more."""
    words = F.split("phrase", " ")
    inner = (
        phrases.filter(F.size(words) > 2)
        .select("lang", F.col("a").alias("outer"), words.alias("words"), F.explode(F.sequence(F.lit(2), F.size(words) - 1)).alias("size"))
        .select("lang", "outer", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
        .select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "outer")
        .groupBy("lang", "phrase")
        .agg(F.max("outer").alias("outer"))
    )
    most = phrases.join(inner, ["lang", "phrase"], "left")
    return most.filter(F.coalesce(100 * F.col("outer") < percent * F.col("a"), F.lit(True))).select(phrases.columns)


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank; a language is ranked in salted parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_TOP_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast(T.LongType())
    return first.drop("salt").withColumn("rank", rank).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, absorb: int = 100, key: str = "doc_id", text: str = "text", lang: str = "lang",
    bits: int = FINGERPRINT_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to five words.

    a, l and r count a phrase and its two parts, n all words of the language. The score is
    floor(1000 a n / (l r)) at the cut where it is lowest. Phrases that a longer frequent phrase
    holds with `absorb` percent of their count are left out. Null languages are `und`, null texts
    empty; rows that repeat count each time; ties go by count and then by the bytes of the phrase.
    An empty table, or one without frequent phrases, gives no rows. Other columns of `docs` are
    not read. `bits` shortens the fingerprints, so that tests can make them collide.
    """
    frequent = stored(frequent_phrases(docs, least, key, text, lang, bits), "frequent-phrases")
    totals = frequent.filter("n = 0").select("lang", F.col("a").alias("n"))
    parts = frequent.filter("n > 0").select("lang", "phrase", "a")
    phrases = frequent.filter("n > 1").select("lang", "phrase", "a")
    scored = _cut_scores(_not_absorbed(phrases, absorb), totals, parts)
    return _ranked(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
