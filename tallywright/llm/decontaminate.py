"""Benchmark passages in documents, by spaced seeds; DataFrame functions only.

A passage counts as found where a document and a benchmark item, laid side by side, agree
on at least 80 percent of a window of 20 words (of the whole item where it is shorter).
Candidates come from spaced seeds: fixed masks pick some words of a stretch and ignore the
others, so a seed survives substitutions at the ignored places. The masks are lossless for
these windows: however the allowed substitutions fall, one mask fits in between them, so
the result does not depend on the masks.

Seeds of the benchmark are broadcast after their number is checked, and documents stream
by once: cut into words, hashed, joined, and verified around each hit in the same stage;
only (document, item) rows are shuffled. A benchmark of more than BROADCAST_WORDS words
joins by shuffle instead: hits as numbers first, and then the words of the documents hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored, words

WINDOW = 20
AGREE = 0.8
#: Items of fewer words are too short to be told from ordinary text; they are not looked for.
LEAST_WORDS = 8
BROADCAST_WORDS = 1_000_000

#: Positions that a seed looks at: lossless for windows of 15 words or more and three in 15 or
#: four in 20 substitutions, and for 8 words or more with one in 8 or two in 10.
LONG_MASKS = ((0, 1, 3, 5, 6), (0, 1, 2, 5, 9))
SHORT_MASKS = ((0, 2, 3, 4), (0, 2, 5, 7))
LONG_FROM = 15


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(tokens: str, start: Column, mask: tuple[int, ...], number: int) -> Column:
    """The hash of the words that a mask picks from `start` (0-based) on; null where it does not fit."""
    picked = [F.get(F.col(tokens), start + offset) for offset in mask]
    return F.when(start + mask[-1] < F.size(tokens), F.xxhash64(F.lit(number), *picked))


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, b, n, window, least): the words of each item and how many of a window must agree."""
    window = F.least(F.size("b"), F.lit(WINDOW))
    return (
        benchmark.select(F.col(item).alias("item_id"), _hashed(F.col(text)).alias("b"))
        .filter(F.size("b") >= LEAST_WORDS)
        .distinct()
        .withColumns({"n": F.size("b"), "window": window, "item_key": F.xxhash64("item_id", "b")})
        .withColumn("least", F.col("window") - F.floor(F.col("window") * (1 - AGREE) + 1e-9).cast("int"))
    )


def _masks_of(items: DataFrame) -> list[tuple[int, tuple[int, ...], bool]]:
    """(number, mask, for short items) of the masks that the items at hand need."""
    short, long = items.agg(F.min("n") < LONG_FROM, F.max("n") >= LONG_FROM).first()
    found = [(i, m, False) for i, m in enumerate(LONG_MASKS) if long]
    return found + [(len(LONG_MASKS) + i, m, True) for i, m in enumerate(SHORT_MASKS) if short]


def _item_seeds(items: DataFrame, masks: list) -> DataFrame:
    """(seed, item_key, q, mask) of every place of every item."""
    at = items.select("item_key", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"))
    fits = lambda short: (F.col("n") < LONG_FROM) if short else (F.col("n") >= LONG_FROM)
    seeds = F.array(*[F.struct(F.when(fits(s), _seed("b", F.col("q"), m, i)).alias("seed"), F.lit(i).alias("mask")) for i, m, s in masks])
    return at.select("item_key", "q", F.explode(seeds).alias("s")).select("item_key", "q", "s.seed", "s.mask").filter("seed IS NOT NULL")


def _document_seeds(docs: DataFrame, masks: list) -> DataFrame:
    """`docs` (doc_id, d) with a row for each place p and mask."""
    at = docs.filter(F.size("d") > 0).select("doc_id", "d", F.explode(F.sequence(F.lit(0), F.size("d") - 1)).alias("p"))
    seeds = F.array(*[_seed("d", F.col("p"), m, i) for i, m, _ in masks])
    return at.select("doc_id", "d", "p", F.explode(seeds).alias("seed")).filter("seed IS NOT NULL")


def _continues(masks: list) -> Column:
    """Whether the same seed also agrees one word earlier, so that an earlier hit stands for this one."""
    same = F.lit(False)
    for i, mask, _ in masks:
        agree = F.lit(True)
        for offset in mask:
            agree = agree & (F.get("d", F.col("p") - 1 + offset) == F.get("b", F.col("q") - 1 + offset))
        same = F.when(F.col("mask") == i, agree & (F.col("p") > 0) & (F.col("q") > 0)).otherwise(same)
    return F.coalesce(same, F.lit(False))


def _with_best(hits: DataFrame) -> DataFrame:
    """Hits (doc_id, d, item columns, diagonal = p - q) with the best window on their diagonal: matched and start.

    `matched` is null where the two overlap in less than a window.
    """
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    high = F.least(F.col("n"), F.size("d") - F.col("diagonal"))  # of the item's words, end exclusive
    aligned = hits.withColumns({"low": low, "span": high - low}).filter(F.col("span") >= F.col("window"))
    agree = F.zip_with(
        F.slice("d", F.col("low") + F.col("diagonal") + 1, F.col("span")),
        F.slice("b", F.col("low") + 1, F.col("span")),
        lambda x, y: F.when(x == y, 1).otherwise(0),
    )
    sums = F.transform(
        F.sequence(F.lit(1), F.col("span") - F.col("window") + 1),
        lambda s: F.struct(
            F.aggregate(F.slice("agree", s, F.col("window")), F.lit(0), lambda t, x: t + x).alias("matched"),
            (-(s - 1 + F.col("low") + F.col("diagonal"))).alias("minus_start"),
        ),
    )
    return aligned.withColumn("agree", agree).withColumn("best", F.array_max(sums))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """(doc_id, item_id, matched, window_words, start_word): documents that hold benchmark passages.

    One row per document and item, for the window that agrees most (the first of equal ones).
    Null and empty texts hold nothing, nor do texts shorter than the window. Repeated rows of
    either table give one row. A null id is an id like any other. Empty tables give no rows.
    """
    items = stored(_items(benchmark, item, item_text), "benchmark-items")
    size = items.agg(F.sum("n")).first()[0] or 0
    masks = _masks_of(items) if size else []
    tokens = docs.select(F.col(key).alias("doc_id"), _hashed(F.col(text)).alias("d"))
    if not masks:
        masks = [(0, LONG_MASKS[0], False)]
    seeds = _item_seeds(items, masks)
    if size <= broadcast_words:
        hits = (
            _document_seeds(tokens, masks)
            .join(F.broadcast(seeds), "seed")  # at most `broadcast_words` times the number of masks
            .join(F.broadcast(items), "item_key")
            .filter(~_continues(masks))
            .withColumn("diagonal", F.col("p") - F.col("q"))
        )
    else:
        met = _document_seeds(tokens.withColumn("doc_key", F.xxhash64("doc_id", "d")).withColumnRenamed("doc_id", "id").withColumnRenamed("doc_key", "doc_id"), masks)
        met = met.select("doc_id", "p", "seed").join(seeds, "seed").select(F.col("doc_id").alias("doc_key"), "item_key", (F.col("p") - F.col("q")).alias("diagonal"))
        met = stored(met.distinct(), "seed-hits")
        wanted = tokens.withColumn("doc_key", F.xxhash64("doc_id", "d"))
        hits = wanted.join(met, "doc_key").join(items, "item_key")
    return (
        _with_best(hits)
        .filter(F.col("best.matched") >= F.col("least"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("best.matched", "best.minus_start", "window")).alias("best"))
        .select(
            "doc_id",
            "item_id",
            F.col("best.matched").cast("long").alias("matched"),
            F.col("best.window").cast("long").alias("window_words"),
            (-F.col("best.minus_start")).cast("long").alias("start_word"),
        )
    )
