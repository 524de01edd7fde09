"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding cuts a text by the tokenizer's pattern and merges each match on its own. A
partition's new words become (word, position, id) rows, which a recursive query joins
to the merge table (pairs of ids with the rank of their union): each round contracts the
leftmost pair of least rank of every word, until no pair of it can be merged. Decoding
selects the tokens of a document's ids from the vocabulary, in order, and joins their bytes.

Words are looked up before they are queried: what a worker has encoded stays known to it
during a stage, up to KNOWN_BYTES, which bounds its memory and never the result. Words longer than
LONG_BYTES, for which rows of every round would be quadratic, are merged with a heap
instead; the ids are the same.
"""

from __future__ import annotations

import base64
import heapq
import sys
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tallywright.llm.common import Batches, extended, place_of, slices
from tallywright.llm.common import giving_back as _giving_back

LONG_BYTES = 300
KNOWN_BYTES = 96 << 20
QUERY_WORDS = 40_000
QUERY_IDS = 1 << 18
_SLICE_CHARS = 1 << 18  # DuckDB keeps what the largest query took for as long as a task lasts
_ENTRY_BYTES = 150  # of a known word besides its letters and ids

# A pair's rank, position and the position that it swallows are one number, so that the least is the leftmost of least rank.
# Positions go on through all words: one order over them all takes less than one a word.
_ENCODE = """
WITH RECURSIVE tokens(word, pos, id, round) AS (
  SELECT word, pos, id, 0 FROM bytes
  UNION ALL
  (
    WITH pairs AS (
      SELECT word, pos, id, lead(word) OVER neighbour AS next_word, lead(id) OVER neighbour AS next_id, lead(pos) OVER neighbour AS next_pos
      FROM tokens WINDOW neighbour AS (ORDER BY pos)
    ), least AS (
      SELECT p.word, min((m.merged::HUGEINT << 64) | (p.pos::HUGEINT << 32) | p.next_pos) AS pair
      FROM pairs p JOIN merges m ON m.first = p.id AND m.second = p.next_id
      WHERE p.next_word = p.word
      GROUP BY p.word
    ), best AS (
      SELECT word, (pair >> 64)::INTEGER AS merged, ((pair >> 32) & 4294967295)::INTEGER AS kept,
             (pair & 4294967295)::INTEGER AS gone
      FROM least
    )
    SELECT t.word, t.pos, CASE WHEN t.pos = b.kept THEN b.merged ELSE t.id END, t.round + 1
    FROM tokens t JOIN best b USING (word)
    WHERE t.pos <> b.gone
  )
), rounds AS MATERIALIZED (
  SELECT * FROM tokens
)
SELECT word, id
FROM rounds JOIN (SELECT word, max(round) AS round FROM rounds GROUP BY word) USING (word, round)
ORDER BY pos
"""

_VOCABULARY = "CREATE TABLE vocabulary AS SELECT list(hex ORDER BY id) AS hexes FROM given"
_DECODE = """
SELECT run, unhex(array_to_string(list_select(hexes, places), '')) AS bytes
FROM runs, vocabulary
"""


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(first, second, merged) of every pair of tokens whose union is a token."""
    rows = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    return np.array(rows, np.int32).reshape(-1, 3)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word: a heap of (rank, position) over linked pieces."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, union = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != union:
            continue
        parts[i], parts[j] = union, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p is not None]


def _known(parts: dict) -> dict:
    """What this worker has encoded so far with `parts`: recent words, about how many bytes they take, and words of before.

    They are kept with the broadcast value, which a worker drops when it goes on to another stage, and they with it.
    Where the recent ones take half of KNOWN_BYTES they become those of before, whose rest is
    forgotten. A word of before that comes again is recent: common words are never queried twice.
    """
    return parts.setdefault("known", {"ids": {}, "older": {}, "bytes": 0})


class Codec:
    """Encodes and decodes in one task; `parts` are the plain values that `shared_parts` makes."""

    def __init__(self, parts: dict):
        self.tokens, self.merges, self.pattern = parts["tokens"], parts["merges"], regex.compile(parts["pattern"])
        self.ranks = {token: i for i, token in enumerate(self.tokens) if token is not None}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.exists = np.array([token is not None for token in self.tokens])
        self.known = _known(parts)
        self.encoded, self.older = self.known["ids"], self.known["older"]
        self.base = None

    def database(self) -> duckdb.DuckDBPyConnection:
        if self.base is None:
            self.base = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": tempfile.gettempdir()})
            merges = pa.table({c: self.merges[:, k] for k, c in enumerate(("first", "second", "merged"))})
            words = pa.table({"id": np.arange(len(self.tokens), dtype=np.int32), "hex": [(t or b"").hex() for t in self.tokens]})
            for rows, sql in ((merges, "CREATE TABLE merges AS SELECT * FROM given"), (words, _VOCABULARY)):
                self.base.register("given", rows)
                self.base.execute(sql)
                self.base.unregister("given")
        return self.base

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        base = self.database()
        base.register(name, rows)
        found = base.sql(sql).to_arrow_table()
        base.unregister(name)
        return found

    def learn_words(self, words: list[str]) -> None:
        """Encodes words that are not known yet."""
        short = []
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:  # a match that is a token is that token
                self.encoded[word] = np.int32(whole).tobytes()
            elif len(raw) > LONG_BYTES:
                self.encoded[word] = np.array(merge_long(raw, self.ranks), np.int32).tobytes()
            else:
                short.append((word, raw))
        for start in range(0, len(short), QUERY_WORDS):
            some = short[start : start + QUERY_WORDS]
            sizes = np.array([len(raw) for _, raw in some])
            ids = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in some), np.uint8)]
            rows = pa.table({"word": np.repeat(np.arange(len(some), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids})
            found = self._query("bytes", rows, _ENCODE)
            raw = found.column("id").to_numpy().astype(np.int32).tobytes()
            edges = np.append(0, np.cumsum(np.bincount(found.column("word").to_numpy(), minlength=len(some)))) * 4
            for (word, _), start, end in zip(some, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self.encoded[word] = raw[start:end]
        self._remember(words)

    def _remember(self, words: list[str]) -> None:
        ids = map(self.encoded.__getitem__, words)
        self.known["bytes"] += _ENTRY_BYTES * len(words) + sum(map(sys.getsizeof, words)) + sum(map(len, ids))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        places: defaultdict[str, int] = defaultdict(count().__next__)  # words are numbered as they come
        matches = [np.fromiter(map(places.__getitem__, self.pattern.findall(t) if t else ()), np.int32) for t in texts]
        words = list(places)
        if self.known["bytes"] > KNOWN_BYTES // 2:
            self.older = self.known["older"] = dict(self.encoded)
            self.encoded.clear()
            self.known["bytes"] = 0
        missing = [word for word in words if word not in self.encoded]
        again = [word for word in missing if word in self.older]
        if again:
            self.encoded.update((word, self.older.pop(word)) for word in again)
            self._remember(again)
        new = [word for word in missing if word not in self.encoded]
        if new:
            self.learn_words(new)
        return _joined(matches, [self.encoded[word] for word in words])

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        ids = np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int32)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.tokens) and self.exists[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        pos = np.arange(len(ids))
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        # A run is a document, or what of it falls into one query.
        opens = (pos % QUERY_IDS == 0) | np.append(True, owner[1:] != owner[:-1])[: len(ids)]
        edges = np.append(np.flatnonzero(opens), len(ids))
        parts: list[bytes] = [b""] * (len(edges) - 1)
        first = np.searchsorted(edges, np.arange(0, len(ids), QUERY_IDS))
        for start, end in pairwise([*first, len(parts)]):
            places = ids[edges[start] : edges[end]] + 1  # DuckDB's lists count from 1
            runs = pa.ListArray.from_arrays(pa.array((edges[start : end + 1] - edges[start]).astype(np.int32)), pa.array(places))
            found = self._query("runs", pa.table({"run": np.arange(start, end, dtype=np.int32), "places": runs}), _DECODE)
            for i, data in zip(found.column("run").to_pylist(), found.column("bytes").to_pylist(), strict=True):
                parts[i] = data
        out: list[list[bytes]] = [[] for _ in lists]
        for i, data in zip(owner[opens].tolist(), parts, strict=True):
            out[i].append(data)
        return [b"".join(some) for some in out]


def _joined(matches: list[np.ndarray], encoded: list[bytes]) -> list[np.ndarray]:
    """The ids of each text, whose matches are places in `encoded`."""
    ids, sizes = np.frombuffer(b"".join(encoded), np.int32), np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    starts = np.cumsum(sizes) - sizes
    found = []
    for places in matches:
        counts = sizes[places]
        ends = np.cumsum(counts)
        found.append(ids[np.arange(counts.sum()) + np.repeat(starts[places] - ends + counts, counts)])
    return found


def shared_parts(path: str, pattern: str) -> dict:
    """What tasks need to know of a vocabulary, as plain values to be broadcast (a few MB, fixed by the vocabulary)."""
    ranks = load_vocabulary(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return {"tokens": tokens, "merges": merge_table(ranks), "pattern": pattern}


def _sliced(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, end, texts) of a batch, in slices: only the texts of one are Python's at a time."""
    pa.default_memory_pool().release_unused()  # else what batches before took stays beside the next
    for start, end in slices(pc.utf8_length(column).fill_null(0).to_pylist(), _SLICE_CHARS):
        yield start, end, column.slice(start, end - start).to_pylist()


def _as_lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """`docs` with the ids of each whole text in `out` (array of int); a null text has none.

    A column of `docs` that is named like `out` is replaced.
    """
    parts = docs.sparkSession.sparkContext.broadcast(shared_parts(path, pattern))
    rest = docs.drop(out)
    at = place_of(rest, text)

    def work(batches: Batches) -> Batches:
        codec = Codec(parts.value)
        for batch in batches:
            for start, end, texts in _sliced(batch.column(at)):
                found = codec.encode(texts)
                yield batch.slice(start, end - start).append_column(out, _as_lists(found))

    return rest.mapInArrow(_giving_back(work), extended(rest, f"`{out}` array<int>"))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`tokens` with the bytes that the ids stand for in `out` (binary); null ids have none.

    An id outside the vocabulary, or a null among the ids, fails the job. A column named like
    `out` is replaced.
    """
    parts = tokens.sparkSession.sparkContext.broadcast(shared_parts(path, pattern))
    rest = tokens.drop(out)
    at = place_of(rest, ids)

    def work(batches: Batches) -> Batches:
        codec = Codec(parts.value)
        for batch in batches:
            column = batch.column(at)
            column = column.fill_null([]) if column.null_count else column
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            values, edges = flat.to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in column])])
            for start, end in slices(np.diff(edges).tolist(), _SLICE_CHARS // 4):
                found = codec.decode([values[edges[i] : edges[i + 1]] for i in range(start, end)])
                yield batch.slice(start, end - start).append_column(out, pa.array(found, pa.binary()))

    return rest.mapInArrow(_giving_back(work), extended(rest, f"`{out}` binary"))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`encode` and `decode` of its ids in one pass over the rows, with the results of both."""
    parts = docs.sparkSession.sparkContext.broadcast(shared_parts(path, pattern))
    rest = docs.drop(ids, out)
    at = place_of(rest, text)

    def work(batches: Batches) -> Batches:
        codec = Codec(parts.value)
        for batch in batches:
            for start, end, texts in _sliced(batch.column(at)):
                found = codec.encode(texts)
                part = batch.slice(start, end - start).append_column(ids, _as_lists(found))
                yield part.append_column(out, pa.array(codec.decode(found), pa.binary()))

    return rest.mapInArrow(_giving_back(work), extended(rest, f"`{ids}` array<int>, `{out}` binary"))
