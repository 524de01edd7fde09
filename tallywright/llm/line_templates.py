"""Recurring lines dropped by log templates; DataFrame functions only.

A line is parsed down a tree of fixed depth: by its number of tokens, then by its first
LEADING tokens; tokens with a digit are variable fields from the start. In a leaf, lines
that agree on all but one stretch of at most a fifth of their tokens share a template in
which that stretch is a variable field. A template that recurs across documents is dropped
from all of them.

Copies of whole documents are no recurring lines: there the surroundings recur too. Each
line has six anchors, the least stretches between punctuation of the document's other lines
under six hashes: long stretches if there are any, else short ones, and the least word where
a document has no other line. Documents that share a template's most common anchor under any
of the hashes are copies of one document and count as one surrounding; the others count by
their different anchors. A template recurs if it has LEAST_DOCUMENTS surroundings, two where
its lines are LONG_TOKENS tokens or more, and if those of the others are at least one in
STRAY of its documents: heavily edited copies may share no anchor by chance.

Templates are 64-bit hashes. A line's row holds its own text alone, so memory grows with a
document's length and never with its square. All counts combine before they shuffle, a
template's lines are never gathered, and joins have an exchange on both sides, so that a
template held by a third of all documents can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm import bitmaps
from tallywright.llm.common import stored, words

LEADING = 3
VARIABLE = 5  # one part in so many may be a variable stretch
LEAST_DOCUMENTS = 3
LONG_TOKENS = 20
STRAY = 20
ANCHORS = 6
UNIT_CHARS = 20

_STRETCHES = 6  # (n - LEADING) / (n // VARIABLE) is never more


def lines_of(text: Column) -> Column:
    """The lines of a text, empty ones included; no lines for null."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _replaced(text: Column | str, old: str, new: str) -> Column:
    """`text` with every character of `old` replaced; byte by byte, which is much faster than `translate`."""
    for c in old:
        text = F.replace(text, F.lit(c), F.lit(new))
    return text


def _stretches(line: Column) -> Column:
    """Hashes of the stretches between punctuation of a line; long ones get negative numbers, so that they come before short ones."""
    hashed = lambda u: F.when(F.length(u) >= UNIT_CHARS, F.xxhash64(F.trim(u)).bitwiseOR(F.lit(-(1 << 63)))).when(
        F.trim(u) != "", F.xxhash64(F.trim(u)).bitwiseAND(F.lit((1 << 63) - 1))
    )
    # Splits at one plain character need no pattern, which Spark would compile for every line; empty parts have no hash.
    return F.transform(F.split(_replaced(line, ".\r", ","), ","), hashed)


def _foremost(hashes: Column) -> Column:
    """The long stretches of a line if there are any, else all; nothing shorter can be the least of them."""
    return F.when(F.array_min(hashes) < 0, F.filter(hashes, lambda h: h < 0)).otherwise(F.filter(hashes, lambda h: h.isNotNull()))


def _least(foremost: Column) -> Column:
    """The least of a line's foremost stretches under every hash; nulls where there is none."""
    sign = F.get(foremost, F.lit(0)).bitwiseAND(F.lit(-(1 << 63)))  # the same for all of them
    other = lambda b: F.transform(foremost, lambda h: F.xxhash64(h, F.lit(b)).bitwiseAND(F.lit((1 << 63) - 1)))
    return F.array(*[F.array_min(other(b)).bitwiseOR(sign) for b in range(ANCHORS)])


def _plain(line: Column | str) -> Column:
    """A line in lower case with single blanks in place of tabs and carriage returns, and none around it."""
    return F.lower(F.trim(_replaced(line, "\t\r", " ")))


def _tokens(plain: str) -> Column:
    """The tokens of a line made plain, those with a digit as variable fields."""
    masked = F.when(F.col(plain).rlike("[0-9]"), F.regexp_replace(plain, "(?<!\\S)[^\\s0-9]*+[0-9]\\S*", "<*>")).otherwise(F.col(plain))
    return F.array_remove(F.split(masked, " "), "")


def _keyed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_key, line_no, n, a0.., keys): a row per line that is not blank, with its number of tokens, anchors and templates."""
    # Two least stretches of different lines per hash: the anchor of a line is the first that is not its own.
    two = lambda b: F.slice(F.sort_array(F.array_distinct(F.array_compact(F.transform("stretches", lambda s: s[b])))), 1, 2)
    texts = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # One step at a time: what a lambda computes it computes again wherever it is used.
    measured = texts.select("doc_key", "body", lines_of(F.col("body")).alias("lines"))
    measured = measured.select("*", F.transform("lines", _stretches).alias("hashes"))
    measured = measured.select("doc_key", "body", "lines", F.transform("hashes", _foremost).alias("hashes"))
    measured = measured.select("doc_key", "body", "lines", F.transform("hashes", _least).alias("stretches"))
    lows = measured.select("doc_key", "body", F.arrays_zip("lines", "stretches").alias("rows"), *[two(b).alias(f"low{b}") for b in range(ANCHORS)])
    alone = F.array_min(F.transform(words(F.col("body")), lambda w: F.xxhash64(w)))
    # Only what is as long as a line, or two numbers, goes on with every line. (No text is without lines; `outer` spares a filter
    # that would measure everything once more.)
    single = F.when(F.size("low0") < 2, alone)
    exploded = lows.select("doc_key", single.alias("alone"), *[f"low{b}" for b in range(ANCHORS)], "rows").select(
        "doc_key", "alone", *[f"low{b}" for b in range(ANCHORS)], F.posexplode_outer("rows").alias("line_no", "row")
    )

    def anchor(b: int) -> Column:
        first, second = F.get(f"low{b}", F.lit(0)), F.get(f"low{b}", F.lit(1))
        return F.coalesce(F.when(F.col("row.stretches")[b].eqNullSafe(first), second).otherwise(first), "alone", F.lit(0))

    # A column of its own for what is looked at and split; the filter looks at the first characters only.
    anchored = [anchor(b).alias(f"a{b}") for b in range(ANCHORS)]
    lines = (
        exploded.filter(F.ltrim("row.lines", F.lit(" \t\r")) != "")
        .select("doc_key", "line_no", *anchored, _plain("row.lines").alias("plain"))
        .select("doc_key", "line_no", *[f"a{b}" for b in range(ANCHORS)], _tokens("plain").alias("tokens"))
        .withColumn("n", F.size("tokens"))
        .withColumn("step", F.floor(F.col("n") / VARIABLE).cast("int"))
    )
    stretch = lambda j: F.xxhash64(F.slice("tokens", LEADING + 1 + j * F.col("step"), F.col("step")))
    open_to = lambda j: (F.col("step") > 0) & (LEADING + j * F.col("step") < F.col("n"))
    parts = lines.withColumns(
        {"lead": F.xxhash64(F.slice("tokens", 1, LEADING)), "whole": F.xxhash64("tokens")}
        | {f"s{j}": F.when(open_to(j), stretch(j)) for j in range(_STRETCHES)}
    )
    rest = lambda j: [F.col(f"s{i}") for i in range(_STRETCHES) if i != j]
    keys = [F.xxhash64(F.lit(-1), "n", "whole")]
    keys += [F.when(F.col(f"s{j}").isNotNull(), F.xxhash64(F.lit(j), "n", "lead", *rest(j))) for j in range(_STRETCHES)]
    return parts.select("doc_key", "line_no", "n", *[f"a{b}" for b in range(ANCHORS)], F.array_compact(F.array(*keys)).alias("keys"))


def _recurring(documents: DataFrame, least: int) -> DataFrame:
    """(key): templates with enough different surroundings, of (key, long, a0..), a row for each document that holds it."""
    anchors = F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"a{b}").alias("anchor")) for b in range(ANCHORS)])
    shared = (
        documents.select("key", F.explode(anchors).alias("a"))
        .groupBy("key", "a.b", "a.anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .groupBy("key", "b")
        .agg(F.max_by("anchor", F.struct("n", "anchor")).alias("anchor"))
    )
    tops = stored(
        shared.groupBy("key").agg(*[F.max(F.when(F.col("b") == b, F.col("anchor"))).alias(f"top{b}") for b in range(ANCHORS)]), "top-anchors"
    )
    copy = F.lit(False)
    for b in range(ANCHORS):
        copy = copy | F.coalesce(F.col(f"a{b}") == F.col(f"top{b}"), F.lit(False))
    judged = documents.join(tops.hint("merge"), "key", "left").select("key", "long", F.when(~copy, F.col("a0")).alias("anchor"))
    counts = judged.groupBy("key", "long", "anchor").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "long").agg(
        F.sum("n").alias("all"), F.count("anchor").alias("different"), F.max(F.col("anchor").isNull().cast("int")).alias("copies")
    )
    enough = F.col("different") + F.col("copies") >= F.when(F.col("long"), F.least(F.lit(least), F.lit(2))).otherwise(least)
    return counts.filter(enough & (STRAY * F.col("different") >= F.col("all"))).select("key")


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_key, dropped): the numbers (from 0) of the lines to drop, for documents that have any."""
    # Numbers only, in place of parsing every text again for the second pass.
    lines = stored(_keyed_lines(docs, key, text), "keyed-lines")
    anchors = [f"a{b}" for b in range(ANCHORS)]
    keyed = lines.select("doc_key", "line_no", "n", *anchors, F.explode("keys").alias("key"))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), (F.max("n") >= LONG_TOKENS).alias("long"))
    enough = F.col("lines") >= F.when(F.col("long"), F.least(F.lit(least), F.lit(2))).otherwise(least)
    common = stored(counted.filter(enough).select("key", "long"), "common-templates")
    # Both grow with the input: merged from the start, never broadcast. Most templates have one line, which a bitmap spares the shuffle.
    likely = bitmaps.marked(keyed.drop("n"), "key", common)
    met = stored(likely.join(common.hint("merge"), "key"), "common-lines")
    documents = met.groupBy("key", "long", "doc_key").agg(*[F.min(a).alias(a) for a in anchors]).drop("doc_key")
    recurring = stored(_recurring(stored(documents, "template-documents"), least), "recurring-templates")
    dropped = met.select("key", "doc_key", "line_no").join(recurring.hint("merge"), "key")
    return dropped.groupBy("doc_key").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """`docs` with recurring lines taken out of `text`, and `dropped_lines`, their numbers in the old text (from 0).

    Every row stays, also where no line is left. Null and empty texts and texts without
    recurring lines stay as they are; blank lines are never dropped. Rows that repeat id and
    text count as one document, a null id is an id like any other. A column `dropped_lines` of
    `docs` is replaced.
    """
    rest = docs.drop("dropped_lines")
    found = stored(recurring_lines(rest, key, text, least), "dropped-lines")
    # One byte a line up to the last one dropped, so that telling lines takes a look each and not a search.
    before = lambda i: F.coalesce(F.get("dropped_lines", i - 1), F.lit(-1))
    mask = F.array_join(F.transform("dropped_lines", lambda d, i: F.concat(F.repeat(F.lit("0"), d - before(i) - 1), F.lit("1"))), "")
    kept = F.filter(lines_of(F.col(text)), lambda line, i: F.substring("__mask", i + 1, F.lit(1)) != F.lit(b"1"))
    joined = (
        rest.withColumn("__doc_key", F.xxhash64(F.col(key), F.col(text)))
        .join(found.select(F.col("doc_key").alias("__doc_key"), F.col("dropped").alias("dropped_lines")).hint("merge"), "__doc_key", "left")
        .drop("__doc_key")
    )
    cleaned = F.when(F.col("dropped_lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    masked = joined.withColumn("__mask", mask.cast("binary")).withColumn(text, cleaned).drop("__mask")
    return masked.withColumn("dropped_lines", F.coalesce("dropped_lines", F.array().cast(T.ArrayType(T.IntegerType()))))
