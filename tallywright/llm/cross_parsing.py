"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A
text is parsed greedily, from left to right, into the longest phrases that occur in
that sample; the language that needs the fewest phrases, weighed by the logarithm of
its sample's length and divided by the text's length, wins.

The automata are built on the driver from at most SAMPLE_ROWS rows and SAMPLE_CHARS
characters a language, both parameters, and broadcast as transition tables of a size
that these bound. Every text is parsed whole, in windows of WINDOW characters (a
phrase ends where its window ends), many windows and all languages at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import extended, place_of

SAMPLE_ROWS = 200
SAMPLE_CHARS = 40_000
PIECE_CHARS = 2_000
WINDOW = 2_000
LETTERS = 44  # letters with a symbol of their own; rarer ones share SHARED symbols
SHARED = 6
UNDETERMINED = "und"

_GAP = 0
_BARRIER = 1 + LETTERS + SHARED
_SYMBOLS = _BARRIER + 1
_SLICE_CHARS = 1 << 21


def learning_pieces(docs: DataFrame, text: str, lang: str, key: str, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """About `rows` pieces of text a language, from rows picked by a hash of their key."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(text) != "")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("mark")
    )
    rates = known.groupBy("lang").agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("rate"))
    start = F.pmod("mark", F.greatest(F.lit(1), F.char_length("text") - PIECE_CHARS + 1)) + 1
    share = F.pmod(F.shiftright("mark", 16), F.lit(1 << 30)) / float(1 << 30)
    picked = (
        known.join(F.broadcast(rates), "lang")  # one row per language
        .filter(share < F.col("rate"))
        .select("lang", "mark", F.substr("text", start.cast("int"), F.lit(PIECE_CHARS)).alias("piece"))
    )
    pieces: dict[str, list[str]] = {}
    for row in sorted(picked.collect()):
        pieces.setdefault(row.lang, []).append(row.piece)
    return pieces


def symbol_table(pieces: dict[str, list[str]]) -> np.ndarray:
    """The symbol of every code point: letters without case; all else is the gap between words."""
    counts = Counter(c for parts in pieces.values() for piece in parts for c in piece.lower() if c.isalpha())
    own = {c: i + 1 for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])}
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if (char := chr(code)).isalpha():
            low = char.lower()[0]
            table[code] = own.get(low, 1 + LETTERS + ord(low) % SHARED)
    return table


def symbols_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols end to end, runs of gaps as one, and each text's number of symbols."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = table[codes]
    ends = np.cumsum(lengths)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != _GAP) | (symbols[:-1] != _GAP)
    keep[(ends - lengths)[lengths > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return symbols[keep], total[ends] - total[ends - lengths]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return moves


def parse_table(moves: list[dict[int, int]], base: int) -> np.ndarray:
    """Per state and symbol: four times the next state's place, plus the phrases that end on the way.

    Where a state has no transition the phrase ends and the symbol starts the next one; a
    symbol that the sample lacks is a phrase of its own.
    """
    table = np.full((len(moves), _SYMBOLS), -1, np.int64)
    for state, found in enumerate(moves):
        for symbol, to in found.items():
            table[state, symbol] = (base + to * _SYMBOLS) * 4
    start = np.where(table[0] >= 0, table[0] + 1, base * 4 + 2)
    lacking = table < 0
    table[lacking] = np.broadcast_to(start, table.shape)[lacking]
    table[0] = np.where(lacking[0], base * 4 + 1, table[0])
    return table.ravel()


def learn_model(pieces: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS) -> dict:
    """Languages, their parse tables end to end, and the symbols of code points; plain values, to be broadcast."""
    symbols, tables, starts, weights, base = symbol_table(pieces), [], [], [], 0
    for lang in sorted(pieces):
        sample: list[int] = []
        for piece in pieces[lang]:
            if len(sample) >= sample_chars:
                break
            sample += [*symbols_of([piece], symbols)[0].tolist(), _BARRIER]
        tables.append(parse_table(automaton(sample[:sample_chars]), base))
        starts.append(base)
        weights.append(math.log2(max(2, min(len(sample), sample_chars))))
        base += len(tables[-1])
    return {
        "languages": sorted(pieces),
        "symbols": symbols,
        "table": np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32),
        "starts": np.array(starts, np.int32),
        "weights": np.array(weights),
    }


def phrases(model: dict, windows: list[np.ndarray]) -> np.ndarray:
    """Phrases of each window (rows) in each language."""
    lengths = np.array([len(w) for w in windows])
    order = np.argsort(-lengths, kind="stable")
    steps = np.zeros((int(lengths.max()), len(windows)), np.int32)
    for column, at in enumerate(order):
        steps[: lengths[at], column] = windows[at]
    active = np.searchsorted(-lengths[order], -np.arange(1, len(steps) + 1), side="right")
    starts = model["starts"][:, None]
    state = np.repeat(starts, len(windows), axis=1)
    counts = np.zeros_like(state)
    for t, n in enumerate(active):
        found = model["table"].take(state[:, :n] + steps[t, :n])
        counts[:, :n] += found & 3
        np.right_shift(found, 2, out=state[:, :n])
    counts += state != starts
    result = np.empty((len(windows), len(starts)), np.int64)
    result[order] = counts.T
    return result


def predict_languages(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text and the share by which the runner-up needs more."""
    symbols, sizes = symbols_of([t or "" for t in texts], model["symbols"])
    ends = np.cumsum(sizes)
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model["languages"]:
        return langs, scores
    letters = np.concatenate([[0], np.cumsum(symbols != _GAP)])
    owners, windows = [], []
    for i in np.flatnonzero(letters[ends] > letters[ends - sizes]):
        for start in range(ends[i] - sizes[i], ends[i], WINDOW):
            owners.append(i)
            windows.append(symbols[start : min(start + WINDOW, ends[i])])
    if not windows:
        return langs, scores
    costs = np.zeros((len(texts), len(model["languages"])))
    np.add.at(costs, np.array(owners), phrases(model, windows) * model["weights"])
    for i in set(owners):
        cost = costs[i] / sizes[i]
        best = int(np.argmin(cost))
        langs[i] = model["languages"][best]
        rest = np.delete(cost, best)
        scores[i] = 1 - cost[best] / rest.min() if len(rest) else 1.0
    return langs, scores


def identify(
    docs: DataFrame,
    learn: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1), learnt from the labelled rows of `learn`.

    Texts that are null or have no letter get `und` and 0, and so does every text where
    nothing could be learnt. Equal texts get equal results. Columns of `docs` that are named
    lang_pred or score are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn_model(learning_pieces(learn, text, lang, key, sample_rows), sample_chars))
    rest = docs.drop("lang_pred", "score")
    at = place_of(rest, text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, held = batch.column(at).to_pylist(), 0, 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1] or "")
                if held >= _SLICE_CHARS or end == len(texts):
                    langs, scores = predict_languages(model.value, texts[start:end])
                    part = batch.slice(start, end - start)
                    yield part.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores))
                    start, held = end, 0

    return rest.mapInArrow(predict, extended(rest, "lang_pred string, score double"))
