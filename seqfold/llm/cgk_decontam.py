"""Benchmark decontamination: find the items of a benchmark inside documents, up to a rate of edits.

The CGK random walk maps a sequence of words to a longer one: step j emits the word under the pointer and
moves on if the j-th random bit of that word is set. Sequences at a small edit distance get embeddings
at a small Hamming distance, and equal ones equal embeddings, so tables that sample a few embedding positions
are a locality-sensitive hash for edit distance. The walk is run from every word of every document at once (each start is a
window), sampled and looked up in each table. A hit is verified by the exact word edit distance between
the item and the best matching span of the item-sized window around it.

An item is not embedded from its first word alone, since edits there would throw its whole walk off. It is cut into
windows of its own, one more than it may have edits, so that of an item within the limit one window at least
has no edit; a table samples only steps at which the item's walk is still inside the window, so that window's sample is the
document's, and the item is found whatever the place and the kind of its edits. Windows with edits behind the sampled
steps, or with walks that meet again, add to that.

The benchmark is taken in blocks of bounded size, one at a time, each broadcast and held against all documents; documents
are never shuffled. Null or empty texts and items match nothing; documents of any length are searched whole;
repeated rows each get their rows; items with equal words each match; items too short for an edit are found by their exact words.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.llm import tokens as T
from seqfold.llm.probminhash import row_key
from seqfold.llm.storage import kept, unused

U = np.uint64
STEPS = (1, 2, 3, 4, 5, 6, 8, 10, 12)  # of the walk: a window is sampled over as many of these as it holds
TABLES, PICKS = 2, 4  # tables for each number of steps, sampled steps in each
RATE = 0.15  # edits for each word of the item that a match may have
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000  # of the benchmark, held at once
_MASK = (1 << 20) - 1


@dataclass
class Table:
    """Windows by their key: the sampled steps, which low bits keys have, the sorted keys, the item of each and the window's first word in it."""

    picks: np.ndarray
    salt: np.ndarray
    marks: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray


@dataclass
class Items:
    """A block of the benchmark: ids, words of each as hashes, and the tables."""

    ids: list[int]
    words: list[np.ndarray]
    tables: list[Table]


def walk(h: np.ndarray, steps: int, stop: np.ndarray) -> np.ndarray:
    """The CGK embeddings from every start in h, as places: a row for each step, len(h) past the end of a start's text."""
    size = len(h)
    bits = np.append(T.salted(h, 77), U(0))
    at, limit, out = np.arange(size, dtype=np.int32), stop.astype(np.int32), np.empty((steps, size), np.int32)
    for j in range(steps):
        there = out[j]
        np.copyto(there, at)
        there[at >= limit] = size
        at += ((bits[there] >> U(j)) & U(1)).astype(np.int32)
    return out


def _samples(steps: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sampled steps of each table and the multipliers of their words: fixed draws. The last step is always sampled."""
    out = []
    for t in range(TABLES if steps > PICKS else 1):
        rng = np.random.default_rng([steps, t])
        picks = np.sort(np.append(rng.choice(steps - 1, min(PICKS, steps) - 1, replace=False), steps - 1))
        out.append((picks.astype(int), rng.integers(1, 1 << 62, len(picks)).astype(U) | U(1)))
    return out


def _keys(emitted, picks: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The hash of the sampled words; emitted(step) gives those of a step."""
    return T.mix(sum((emitted(j) * m for j, m in zip(picks[1:], salt[1:], strict=True)), emitted(picks[0]) * salt[0]))


def windows(n: int, rate: float = RATE) -> list[tuple[int, int]]:
    """(first word, words) of an item's windows: one more than it may have edits, apart from each other."""
    pieces = int(rate * n) + 1
    return [(i * n // pieces, n // pieces) for i in range(pieces)]


def index(ids: list[int], texts: list, rate: float = RATE) -> Items:
    w = T.words(texts)
    parts = [w.hash[a:b] for a, b in zip(w.bounds, w.bounds[1:], strict=False)]
    known = [(i, p) for i, p in zip(ids, parts, strict=True) if len(p)]
    cut = [(k, a, p[a : a + size]) for k, (_, p) in enumerate(known) for a, size in windows(len(p), rate)]
    h = np.concatenate([np.zeros(0, U), *(x for *_, x in cut)])
    first = np.cumsum([0, *(len(x) for *_, x in cut)])
    places = walk(h, STEPS[-1], np.repeat(first[1:], np.diff(first)))[:, first[:-1]]
    inside = (places < len(h)).sum(axis=0)  # steps of each window's walk
    item, place, ended = np.array([k for k, *_ in cut], np.int64), np.array([a for _, a, _ in cut], np.int64), np.append(h, U(0))
    tables = []
    for c, more in zip(STEPS, [*STEPS[1:], 1 << 30], strict=True):
        at = np.flatnonzero((inside >= c) & (inside < more))
        for picks, salt in _samples(c) if len(at) else []:
            keys = _keys(lambda j, at=at: ended[places[j, at]], picks, salt)
            order = np.argsort(keys, kind="stable")
            marks = np.zeros(_MASK + 1, bool)
            marks[(keys & U(_MASK)).astype(np.int64)] = True
            tables.append(Table(picks, salt, marks, keys[order], item[at[order]], place[at[order]]))
    return Items([i for i, _ in known], [p for _, p in known], tables)


def best_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least word edit distance between item and a span of text, and that span's first word.

    One row of the dynamic programme for each word of the item, vectorised over the text; the start of
    the best span is carried along (of equal distances the later start)."""
    n = len(text)
    wide = n + 2
    small = np.int32 if (len(item) + n + 2) * wide < 1 << 31 else np.int64
    row = n - np.arange(n + 1, dtype=small)  # distance * wide + (n - start): the least is the nearest, then latest, start
    steps = np.arange(n + 1, dtype=small) * small(wide)
    for word in item:
        new = row + small(wide)
        np.minimum(new[1:], row[:-1] + (text != word) * small(wide), out=new[1:])
        new -= steps
        row = np.minimum.accumulate(new, out=new)
        row += steps
    best = int(row.min())
    return best // wide, n - best % wide


def _slack(n: int, rate: float) -> int:
    """How far before an item's expected first word a match may begin; it ends at most twice as far behind."""
    return int(rate * n) + 2 if rate * n >= 1 else 0


def _stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where a new stretch of overlapping spans begins; both ends never fall."""
    return np.flatnonzero(np.append(True, low[1:] >= high[:-1]))


def _matches(item: np.ndarray, at: np.ndarray, h: np.ndarray, begin: np.ndarray, stop: np.ndarray, rate: float) -> list[tuple[int, int]]:
    """(edits, first word) of the best match of item in each stretch of overlapping spans around the hits at, if it is within the limit.

    A span with too few of the item's words cannot hold a match: as many of its places have one of them as a match has words unedited. These are
    counted once over a stretch, whatever the number of hits in it; an exact copy is seen at once; else one dynamic programme serves a stretch, so
    an item of n words whose edits lie dense costs n rows of the stretch's length, not n rows for each hit."""
    n, slack = len(item), _slack(len(item), rate)
    low, high, own = np.maximum(begin[at], at - slack), np.minimum(stop[at], at + n + 2 * slack), np.sort(item)
    first = _stretches(low, high)
    size = high[np.append(first[1:], len(at)) - 1] - low[first]
    offset = np.cumsum(size) - size
    place = np.arange(size.sum()) + np.repeat(low[first] - offset, size)
    has = np.append(0, np.cumsum(own[np.minimum(np.searchsorted(own, h[place]), n - 1)] == h[place]))
    shift = np.repeat(offset - low[first], np.diff(np.append(first, len(at))))
    good = has[high + shift] - has[low + shift] >= n - int(rate * n)
    at, low, high, out = at[good], low[good], high[good], []
    if not len(at):
        return out
    ends = np.minimum(at + n - 1, len(h) - 1)
    whole = (at + n <= stop[at]) & (h[at] == item[0]) & (h[ends] == item[-1])
    first = _stretches(low, high)
    for a, b in zip(first, np.append(first[1:], len(at)), strict=True):
        copy = next((int(x) for x in at[a:b][whole[a:b]] if np.array_equal(h[x : x + n], item)), None)
        if copy is not None:
            out.append((0, copy))
        elif slack:
            edits, start = best_span(item, h[low[a] : high[b - 1]])
            if edits <= rate * n:
                out.append((edits, int(low[a]) + start))
    return out


def search(texts: list, items: Items, rate: float = RATE) -> list[tuple[int, int, int, int]]:
    """(text, item id, first word, edit distance) of the best match of each item in each text that it matches."""
    w = T.words(texts)
    h, bounds, doc = w.hash, w.bounds, w.doc
    if not len(h) or not items.ids:
        return []
    begin, ended = bounds[:-1][doc], np.append(h, U(0))  # a walk emits 0 past the end of its text
    embedded = walk(h, STEPS[-1], bounds[1:][doc])
    emitted = [ended[x] for x in embedded]
    start, member = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in items.tables:
        key = _keys(emitted.__getitem__, t.picks, t.salt)
        at = np.flatnonzero(t.marks[(key & U(_MASK)).astype(np.int64)])
        lo, hi = np.searchsorted(t.keys, key[at], "left"), np.searchsorted(t.keys, key[at], "right")
        n = hi - lo
        hit = np.repeat(np.arange(len(at)), n)
        row = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + lo[hit]
        start.append(np.maximum(at[hit] - t.place[row], begin[at[hit]]))
        member.append(t.item[row])
    pair = np.unique(np.stack([np.concatenate(member), np.concatenate(start)]), axis=1)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    edge = np.flatnonzero(np.diff(pair[0], prepend=-1, append=-1))
    for a, b in zip(edge, edge[1:], strict=False):
        k = int(pair[0, a])
        for edits, first in _matches(items.words[k], pair[1, a:b], h, begin, bounds[1:][doc], rate):
            d = int(doc[min(first, len(doc) - 1)])
            best[d, k] = min(best.get((d, k), (1 << 60, 0)), (edits, first))
    return [(d, items.ids[k], first - int(bounds[d]), edits) for (d, k), (edits, first) in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark as driver-side lists (ids, texts) within BLOCK_ITEMS rows and about BLOCK_CHARS characters each.

    The number of blocks comes from a count; a hash of the id deals the rows out."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    k = max(1, -(-n // (BLOCK_ITEMS // 2)), -(-chars // (BLOCK_CHARS // 2)))
    for b in range(k):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(k)) == b).orderBy("id", "text").collect()
        yield [r.id for r in rows], [r.text for r in rows]


_held: dict[str, Items] = {}


def _indexed(name: str, block: tuple[list, list], rate: float) -> Items:
    """The index of a block; a worker keeps the last one for its next tasks."""
    if name not in _held:
        _held.clear()
        _held[name] = index(*block, rate)
    return _held[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, first_word, edits) for each document and benchmark item that it holds.

    With several blocks the findings of each are written before the next block is fetched, so that one is held at a time."""
    spark, out, last = docs.sparkSession, None, None
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int64())])
    for ids, items in blocks(benchmark, item_id, item_text):
        if last is not None:
            out = _written(out, *last)
        shared, name = spark.sparkContext.broadcast((ids, items)), uuid.uuid4().hex

        def scan(batches, shared=shared, name=name):
            known = _indexed(name, shared.value, rate)
            for b in batches:
                names, texts = b.column("doc_id"), b.column("text").to_pylist()
                rows = [(names[lo + d].as_py(), *hit) for lo, hi in T.chunks(texts, 400_000) for d, *hit in search(texts[lo:hi], known, rate)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], schema=schema)

        last = (texts.mapInArrow(scan, "doc_id long, item_id long, first_word long, edits long"), shared)
    return last[0] if out is None else _written(out, *last)


def _written(out: DataFrame | None, part: DataFrame, shared) -> DataFrame:
    """out and part, whose rows are written, so that its block is needed no more."""
    done = kept(part)
    shared.destroy()
    return done if out is None else out.unionByName(done)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item, whether or not their ids are null or repeated; rows with a null text stay."""
    (row,) = unused(docs, "row")
    keyed = docs.withColumn(row, row_key(id_col, text_col))
    found = contaminated(keyed, benchmark, row, text_col, rate=rate).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(found, row, "left_anti").select(docs.columns)
