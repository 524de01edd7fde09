"""Toxicity from maximum-scoring segments of token log-odds.

The words of toxic and of clean documents are two multinomials. Each has a Dirichlet prior
that gives every word PRIOR tokens, shared between the two like all tokens; a word's share is
moved towards that of its stem, the words that share its first letters, which has a prior
of the same kind. A token scores the log of how much likelier it is in toxic text, less a
small toll, which makes the expected score of ordinary text negative. One linear scan then
finds all maximal-scoring segments of a text: every passage that cannot be extended or cut
without losing score.

Scores become comparable across text lengths by the extreme-value law of such segments
(expected number of equally good ones by chance: K n exp(-lambda S)), with lambda and K
taken from clean labelled documents; the evidence of a document's significant passages
adds up, and a logistic curve turns it into a probability.

Learning takes at most about MAX_LABELLED labelled rows, three quarters for the tokens
and one for the calibration; all tokens of their whole texts count, by the same cut into
words as in scoring. Words and stems have scores where the number of toxic documents that
hold them is no chance, which a document cannot bring about by repeating a word; with scores
for all words, the noise of thousands adds up to passages. Scoring reads every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import extended, place_of, stored

MAX_LABELLED = 20_000
LEAST_DOCS = 5
LEAST_FAR = 4.0  # standard deviations
STEM = 4  # letters
PRIOR = 10.0  # tokens
TOLL = 0.5
STEPS = 128  # scores are counted to this part of a nat for lambda
LEAST_RATE = 0.1  # where no lambda solves the equation, as ordinary text gains score
TAIL = 4.0  # rate by which the texts that grow most are told
ATOM = 1.0  # score from which segments count for K
SIGNIFICANT = 0.05  # expected number of passages as good by chance

_TOKEN = re.compile(r"\w+")
_CACHE_WORDS = 100_000  # bounds a task's memory; scores are computed again when it is emptied
_PASSAGES = "array<struct<start:bigint,end:bigint,score:double,by_chance:double>>"


def labelled_sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """(key, toxic, mark) of about `rows` labelled keys at most, picked by a hash; a key labelled twice counts as its larger label."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.col(label)).cast("int").alias("toxic"))
    )
    rate = min(1.0, rows / max(1, known.count()))
    mark = F.pmod(F.xxhash64("key", F.lit("toxic")), F.lit(1 << 30))
    return known.withColumn("mark", mark).filter(F.col("mark") < rate * (1 << 30))


def stem(word: str) -> str:
    return word[:STEM] + "*"


def count_units(rows: DataFrame, least_docs: int = LEAST_DOCS, least_far: float = LEAST_FAR) -> tuple[list[tuple], int, int]:
    """Words and stems that tell the labels apart, with their tokens in toxic and in clean documents; and the totals of tokens.

    Those count that stand in at least `least_docs` documents, of which the toxic ones are
    `least_far` standard deviations more or fewer than the totals let expect.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["unit", "toxic_tokens", "clean_tokens", "toxic_docs", "docs"]
        for batch in batches:
            tokens, toxic_docs, docs = (Counter(), Counter()), Counter(), Counter()
            for toxic, body in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                units = Counter(_tokens(body))
                for word, times in list(units.items()):
                    units[stem(word)] += times
                tokens[int(toxic > 0)].update(units)
                docs.update(units.keys())
                toxic_docs.update(units.keys() if toxic > 0 else ())
            found = list(docs)
            numbers = [pa.array([counts[u] for u in found], pa.int64()) for counts in (tokens[1], tokens[0], toxic_docs, docs)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *numbers], names)

    counted = rows.select("toxic", "text").mapInArrow(count, "unit string, toxic_tokens long, clean_tokens long, toxic_docs long, docs long")
    sums = stored(counted.groupBy("unit").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]]), "toxic-units")
    # No word holds a star; stems would count everything a second time.
    totals = sums.filter(~F.col("unit").endswith("*")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns[1:]]).first()
    share = totals.toxic_docs / max(1, totals.docs)
    far = F.abs(F.col("toxic_docs") - F.col("docs") * share) / F.sqrt(F.col("docs") * share * (1 - share) + 1e-9)
    found = sums.filter((F.col("docs") >= least_docs) & (far >= least_far)).select("unit", "toxic_tokens", "clean_tokens").collect()
    return [tuple(u) for u in found], totals.toxic_tokens, totals.clean_tokens


def log_odds(units: list[tuple], toxic: int, clean: int, prior: float = PRIOR) -> dict[str, float]:
    """Scores of words and stems ('abcd*').

    With Dirichlet priors of `prior * share` tokens for a word in toxic text and of the rest in clean
    text, the sums over the vocabulary cancel, and the log-odds are those of the smoothed share. The
    share behind the prior is that of all tokens for a stem, and the stem's own for a word.
    """
    share = (toxic + 1) / (toxic + clean + 2)
    base = math.log(share / (1 - share))
    counts = {u: (t, c) for u, t, c in units}

    def mean(unit: str, before: float) -> float:
        t, c = counts.get(unit, (0, 0))
        return (t + prior * before) / (t + c + prior)

    scores = {}
    for unit in counts:
        family = mean(unit if unit[-1] == "*" else stem(unit), share)
        p = family if unit[-1] == "*" else mean(unit, family)
        scores[unit] = math.log(p / (1 - p)) - base
    return scores


class _Scores(dict):
    """Token scores less the toll; unknown words score as their stem."""

    def __init__(self, units: dict[str, float], toll: float):
        self.units, self.toll = units, toll

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        score = self.units.get(word)
        if score is None:
            score = self.units.get(stem(word), 0.0)
        self[word] = score - self.toll
        return self[word]


def score_tokens(words: list[str], scores: _Scores) -> list[float]:
    """Scores of a text's tokens; what speaks for toxicity counts by half the second time a word comes, a third the third."""
    found = list(map(scores.__getitem__, words))
    seen: dict[str, int] = {}
    for at, score in enumerate(found):
        if score > 0:
            seen[words[at]] = times = seen.get(words[at], 0) + 1
            found[at] = (score + scores.toll) / times - scores.toll
    return found


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence, in one linear scan."""
    found: list[list] = []  # first, end, sum before, sum after, nearest earlier one that starts lower
    total = 0.0
    for at, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        segment = [at, at + 1, total, total + score]
        total += score
        back = len(found) - 1
        while True:
            while back >= 0 and found[back][2] >= segment[2]:
                back = found[back][4]
            if back < 0 or found[back][3] >= segment[3]:
                found.append([*segment, back])
                break
            segment = [found[back][0], segment[1], found[back][2], segment[3]]
            del found[back:]
            back -= 1
    return [(first, end, after - before) for first, end, before, after, _ in found]


def _tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def spectrum(scores: list[float]) -> dict[int, int]:
    """How many tokens of a text have each score, in steps of a nat's STEPS-th part: of fixed size, however long the text."""
    return Counter(round(s * STEPS) for s in scores)


def growth_rate(spectra: list[dict[int, int]]) -> float:
    """lambda: the positive root of mean(exp(lambda * score)) = 1 over all tokens, by bisection.

    There is one exactly where the mean score is negative and some score positive. Without a
    positive score any rate is safe, and that of log-odds themselves, 1, is returned; with a
    mean that is not negative, LEAST_RATE.
    """
    total: Counter = Counter()
    for counts in spectra:
        total.update(counts)
    if not total or max(total) <= 0:
        return 1.0
    scores = np.array(list(total), float) / STEPS
    shares = np.array(list(total.values()), float)
    shares /= shares.sum()
    if float(scores @ shares) >= 0:
        return LEAST_RATE

    def gains(rate: float) -> bool:
        top = rate * scores.max()
        return top + math.log(float(shares @ np.exp(rate * scores - top))) >= 0

    high = 1.0
    while not gains(high):
        high *= 2
    low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if gains(middle) else (middle, high)
    return high


def fit_extremes(spectra: list[dict[int, int]], sizes: np.ndarray, segments: np.ndarray) -> tuple[float, float]:
    """lambda and log K of the extreme-value law of ordinary text.

    lambda is where the mean of exp(lambda * score) over tokens is one; K follows from the
    number of segments of score ATOM or more. The texts that grow most by length, one in a
    hundred, are left out: labels err.
    """
    use = np.flatnonzero(sizes > 0)
    if not len(use):
        return 1.0, 0.0
    means = np.array([sum(n * math.exp(TAIL * s / STEPS) for s, n in spectra[i].items()) / sizes[i] for i in use])
    plain = use[means <= np.quantile(means, 0.99)]
    rate = growth_rate([spectra[i] for i in plain])
    return rate, math.log((1 + segments[plain].sum()) / sizes[plain].sum()) + rate * ATOM


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve with a weak ridge; the slope is not negative."""
    if len(x) == 0:
        return 0.0, 1.0
    a, b = 0.0, 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        ga, gb = float((y - p).sum() - 0.01 * a), float(((y - p) * x).sum() - 0.01 * b)
        haa, hab, hbb = float(w.sum()) + 0.01, float((w * x).sum()), float((w * x * x).sum()) + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = a + da / size, b + db / size
    return a, max(b, 0.0)


def evidence(segments: list[tuple[int, int, float]], size: int, rate: float, log_k: float) -> tuple[float, list[tuple]]:
    """What speaks for toxicity, in nats, and the significant passages with their expected number by chance."""
    if not segments:
        return -math.log(max(1, size)) - log_k, []
    nats = [(rate * s - log_k - math.log(max(1, size)), first, end, s) for first, end, s in segments]
    passages = [(first, end, s, math.exp(min(50.0, -n))) for n, first, end, s in nats if math.exp(min(50.0, -n)) <= SIGNIFICANT]
    strong = [n for n, *_ in nats if math.exp(min(50.0, -n)) <= SIGNIFICANT]
    return (sum(strong) if strong else max(n for n, *_ in nats)), passages


def learn(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int) -> dict:
    """Token scores, extreme-value law and curve: plain values, to be broadcast."""
    sample = labelled_sample(labels, key, label, rows)
    known = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = known.join(F.broadcast(sample), "key")  # bounded by `rows`
    units = log_odds(*count_units(known.filter("mark % 4 <> 0")))
    model = {"units": units, "rate": 1.0, "log_k": 0.0, "curve": (0.0, 1.0)}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(units)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value, TOLL)
        for batch in batches:
            rows = [_tokens(t) for t in batch.column("text").to_pylist()]
            values = [score_tokens(r, scores) for r in rows]
            found = [maximal_segments(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([[s for *_, s in f] for f in found], pa.list_(pa.float64())),
                    pa.array([list(spectrum(v).items()) for v in values], pa.map_(pa.int32(), pa.int64())),
                ],
                ["toxic", "size", "scores", "spectrum"],
            )

    # At most a quarter of `rows` rows.
    held = known.filter("mark % 4 = 0").select("toxic", "text").mapInArrow(best, "toxic int, size long, scores array<double>, spectrum map<int, long>").collect()
    sizes = np.array([r.size for r in held], float)
    toxic = np.array([r.toxic for r in held], float)
    if len(held):
        many = np.array([sum(s >= ATOM for s in r.scores) for r in held])
        clean = toxic == 0
        model["rate"], model["log_k"] = fit_extremes([r.spectrum for r in held if r.toxic == 0], sizes[clean], many[clean])
        x = np.array([_told(evidence([(0, 0, s) for s in r.scores], r.size, model["rate"], model["log_k"])[0]) for r in held])
        model["curve"] = fit_curve(x, toxic)
    return model


def _told(nats: float) -> float:
    """Evidence on a scale where very much counts as much."""
    return math.copysign(math.log1p(abs(nats)), nats)


def score_toxicity(
    docs: DataFrame,
    learn_docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """`docs` with toxicity (0 to 1) and toxic_passages (first and end character, score, expected number by chance).

    Learnt from the rows of `learn_docs` that `labels` marks 0 or 1; null labels, keys and
    texts teach nothing. Null and empty texts are scored as texts without any passage. With
    no labels at all every text scores alike. Columns of `docs` with the names of the new ones
    are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(learn_docs, labels, text, key, label, max_labelled))
    rest = docs.drop("toxicity", "toxic_passages")
    at = place_of(rest, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scores, (a, b) = _Scores(m["units"], TOLL), m["curve"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("by_chance", pa.float64())]))
        for batch in batches:
            values, passages = [], []
            for item in batch.column(at):
                body = item.as_py()
                words = _tokens(body)
                nats, found = evidence(maximal_segments(score_tokens(words, scores)), len(words), m["rate"], m["log_k"])
                values.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * _told(nats))))))
                if found:
                    spans = [x.span() for x in _TOKEN.finditer(body.lower())]
                    found = [{"start": spans[f][0], "end": spans[e - 1][1], "score": s, "by_chance": c} for f, e, s, c in found]
                passages.append(found)
            yield batch.append_column("toxicity", pa.array(values)).append_column("toxic_passages", pa.array(passages, kind))

    return rest.mapInArrow(score, extended(rest, f"toxicity double, toxic_passages {_PASSAGES}"))


def toxic(score: Column, threshold: float = 0.7) -> Column:
    return (score >= threshold).cast("int")
