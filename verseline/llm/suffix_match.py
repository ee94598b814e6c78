"""Benchmark decontamination with suffix arrays over the training text.

Each partition cuts its documents into shards of about ``SHARD`` words and
builds a word-level suffix array of each, by prefix doubling to a depth of at
least the window.  Every suffix of the benchmark items is binary-searched in
every shard, all of them at once: the occurrences of its window are a range of
the suffix array.  From each of them the suffix array of the benchmark, searched
the other way round, gives the longest verbatim match and where it stands on
both sides.  Shards are independent, so nothing of the corpus is shuffled.

The benchmark is broadcast in blocks of about ``BLOCK`` words, at most
``BLOCKS`` of them at once; a worker holds one block at a time and walks all of
them for each shard it has built.  A larger benchmark takes a further pass for
each ``BLOCKS`` blocks, with the result so far written in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.text_scan import ALNUM, Words, slices, strings
from verseline.llm.tables import bound_batches, lean, materialize

SHARD = 1 << 18
#: a block is about 32 MB
BLOCK, BLOCKS = 1_000_000, 16


class SuffixArray:
    """Suffixes of a token array, sorted by their first ``depth`` tokens, or wholly if depth is None."""

    def __init__(self, tokens: np.ndarray, depth: int | None):
        """tokens: non-negative ids below 2^31, ended by zeros that match nothing."""
        n = len(tokens)
        padded = np.zeros(n + 3, np.int64)
        padded[:n] = tokens
        top = int(tokens.max(initial=0)) + 1
        held = 3 if top < 1 << 21 else 2
        width = 21 if held == 3 else 31
        key = padded[:n].copy()
        for i in range(1, held):
            key <<= width
            key |= padded[i : n + i]
        self.order = np.argsort(key)
        ordered = key[self.order]
        fresh = np.ones(n, bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.zeros(n + 1, np.int64)
        #: a suffix's rank is the place of the first suffix equal to it so far
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        done = held
        while depth is None or done < depth:
            tie = ~fresh
            tie[:-1] |= ~fresh[1:]
            # runs of separators need no order among themselves
            at = np.flatnonzero(tie & (tokens[self.order] > 0))
            if not len(at):
                break
            places = self.order[at]
            second = rank[np.minimum(places + done, n)]
            again = np.argsort((rank[places] << 32) | second)
            self.order[at] = places = places[again]
            first, second = rank[places], second[again]
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            fresh[at] = new | fresh[at]
            rank[places] = np.maximum.accumulate(np.where(new, at, 0))
            done *= 2
        self.tokens = tokens

    def search(self, queries: np.ndarray, sizes: np.ndarray, after: bool, within: tuple[np.ndarray, np.ndarray] | None = None, skip: int = 0) -> np.ndarray:
        """For each query row the first place whose suffix, cut to the query's size, is not below it (after: above it).

        within: places to search between; skip: words of the suffixes that are known to agree there.
        """
        lo, hi = (x.copy() for x in within) if within else (np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order), np.int64))
        last = len(self.tokens) - 1  # a separator
        span = np.arange(queries.shape[1])
        outside = span[None, :] >= sizes[:, None]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            have = self.tokens[np.minimum(self.order[mid][:, None] + span + skip, last)]
            want = queries[open_]
            differ = (have != want) & ~outside[open_]
            first = differ.argmax(axis=1)
            row = np.arange(len(open_))
            some = differ[row, first]
            below = some & (have[row, first] < want[row, first])
            go = below | ~some if after else below
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]
        return lo


def word_hashes(column: pa.Array) -> Iterator[tuple[int, Words]]:
    data, offsets = strings(column)
    for lo, hi in slices(offsets):
        yield lo, Words(data, offsets[lo : hi + 1], ALNUM)


class Shard:
    """The suffix array of some texts' words."""

    def __init__(self, parts: list[np.ndarray], depth: int | None):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.hashes = np.concatenate(parts) if len(parts) else np.zeros(0, np.uint64)
        self.words, ids = np.unique(self.hashes, return_inverse=True)
        #: where each text's words start; a zero stands after each
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        #: where each word stands
        self.at = np.arange(len(self.hashes)) + np.repeat(np.arange(len(parts)), sizes)
        tokens = np.zeros(int(self.starts[-1]) + (not len(parts)), np.int32)
        tokens[self.at] = 2 * ids + 2
        self.array = SuffixArray(tokens, depth)

    def translate(self, hashes: np.ndarray) -> np.ndarray:
        """Ids in this shard's order; a word the shard does not have gets an odd id at its place."""
        at = np.searchsorted(self.words, hashes)
        known = self.words[np.minimum(at, len(self.words) - 1)] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        return np.where(known, 2 * at + 2, 2 * at + 1).astype(np.int32)

    def place(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, word in it) of token places."""
        text = np.searchsorted(self.starts, tokens, "right") - 1
        return text, tokens - self.starts[text]


class Items(NamedTuple):
    """Benchmark items: their words' hashes end to end, each item's range, names as text, and their own suffix array."""

    hashes: np.ndarray
    bounds: np.ndarray
    names: list[str]
    index: Shard


def load_items(bench: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks; it is read by partition, not all at once."""
    hashes: list[np.ndarray] = []
    names: list[str] = []
    held = 0

    def block() -> Items:
        return Items(np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(h) for h in hashes], dtype=np.int64))), list(names), Shard(hashes, None))

    for row in bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        for _, words in word_hashes(pa.array([row.t], pa.string())):
            if len(words.hashes):
                hashes.append(words.hashes)
                names.append(row.i if row.i is not None else "")
                held += len(words.hashes)
        if held >= BLOCK:
            yield block()
            hashes, names, held = [], [], 0
    if names:
        yield block()


def windows(items: Items, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, words, item) of every window."""
    lengths = np.diff(items.bounds)
    each = np.maximum(1, lengths - size + 1)
    owner = np.repeat(np.arange(len(lengths)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    return items.bounds[owner] + nth, np.minimum(size, lengths[owner]), owner


def occurrences(shard: Shard, items: Items, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(token place, words, window) of every occurrence of a window in the shard, and each window's items.

    Windows that read alike are one, so there are at most as many occurrences as words for each window length.
    """
    ids = np.concatenate((shard.translate(items.hashes), np.ones(size, np.int32)))
    start, length, owner = windows(items, size)
    some = (ids[start] & 1) == 0
    start, length, owner = start[some], length[some], owner[some]
    queries = ids[start[:, None] + np.arange(size)]
    odd = ((queries & 1) == 1) & (np.arange(size)[None, :] < length[:, None])
    some = ~odd.any(axis=1)
    queries, length, owner = queries[some], length[some], owner[some]
    lo = shard.array.search(queries, length, False)
    hi = shard.array.search(queries, length, True)
    found = lo < hi
    lo, hi, length, owner = lo[found], hi[found], length[found], owner[found]
    _, first, group = np.unique(lo * (size + 1) + length, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    owners = np.split(owner[order], np.cumsum(np.bincount(group))[:-1]) if len(group) else []
    lo, length, n = lo[first], length[first], (hi - lo)[first]
    flat = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return shard.array.order[flat], np.repeat(length, n), np.repeat(np.arange(len(n)), n), [np.unique(o) for o in owners]


#: words that are compared at a time
WIDTH = 16


def _chunk(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, skip: int) -> np.ndarray:
    """The next WIDTH ids of each query; beyond its end stands 1, which no word has."""
    at = start[:, None] + skip + np.arange(WIDTH)
    return np.where(at < stop[:, None], ids[np.minimum(at, len(ids) - 1)], 1)


def reach(index: Shard, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, token place): a longest match of each ids[start:stop] with a wholly sorted index; 0 words without any."""
    place = np.zeros(len(start), np.int64)
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(index.array.order), np.int64)
    todo, skip = np.arange(len(start)), 0
    while len(todo):
        queries, sizes = _chunk(ids, start[todo], stop[todo], skip), np.full(len(todo), WIDTH)
        within = lo[todo], hi[todo]
        lo[todo], hi[todo] = index.array.search(queries, sizes, False, within, skip), index.array.search(queries, sizes, True, within, skip)
        place[todo] = lo[todo]
        todo, skip = todo[lo[todo] < hi[todo]], skip + WIDTH
    best, where = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    order, tokens = index.array.order, index.array.tokens
    for beside in (place - 1, place):
        inside = (beside >= 0) & (beside < len(order))
        at = order[np.clip(beside, 0, len(order) - 1)]
        words = np.zeros(len(start), np.int64)
        todo, skip = np.flatnonzero(inside), 0
        while len(todo):
            have = tokens[np.minimum(at[todo][:, None] + skip + np.arange(WIDTH), len(tokens) - 1)]
            same = (have == _chunk(ids, start[todo], stop[todo], skip)).cumprod(axis=1).sum(axis=1)
            words[todo] += same
            todo, skip = todo[same == WIDTH], skip + WIDTH
        better = (words > best) | (words == best) & (at < where)
        best, where = np.where(better, words, best), np.where(better, at, where)
    return best, where


def every_place(index: Shard, ids: np.ndarray, start: int, words: int) -> np.ndarray:
    """All token places of the index where ids[start : start + words] stands."""
    lo, hi = np.zeros(1, np.int64), np.full(1, len(index.array.order), np.int64)
    for skip in range(0, words, WIDTH):
        size = np.array([min(WIDTH, words - skip)])
        queries = _chunk(ids, np.array([start]), np.array([start + words]), skip)
        lo, hi = index.array.search(queries, size, False, (lo, hi), skip), index.array.search(queries, size, True, (lo, hi), skip)
    return index.array.order[lo[0] : hi[0]]


def longest_of_texts(shard: Shard, items: Items, size: int, places: np.ndarray, length: np.ndarray, window: np.ndarray, owners: list[np.ndarray]) -> dict[int, tuple[int, int, str, int]]:
    """For each text with an occurrence: (words, word in the text, item, word in the item) of its longest verbatim match
    of at least a window; of equal ones the first in the text, then in the first item by name, then first in the item."""
    ids = np.ones(len(shard.array.tokens), np.int32)
    ids[shard.at] = items.index.translate(shard.hashes)
    text, at = shard.place(places)
    words, _ = reach(items.index, ids, places, shard.starts[text + 1] - 1)
    # a match of less than the full window counts only as a whole short item
    words = np.where(words >= size, words, length)
    order = np.lexsort((at, -words, text))
    order = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))] if len(order) else order
    out = {}
    for i in order.tolist():
        if words[i] >= size:
            item, word = items.index.place(every_place(items.index, ids, int(places[i]), int(words[i])))
        else:
            item = owners[window[i]]
            word = np.zeros(len(item), np.int64)
        name, word = min((items.names[a], b) for a, b in zip(item.tolist(), word.tolist()))
        out[int(text[i])] = (int(words[i]), int(at[i]), name, word)
    return out


def shards(batches: Iterator[pa.RecordBatch], text_at: int, depth: int | None) -> Iterator[tuple[pa.RecordBatch, Shard, list[int]]]:
    """(rows, their shard, words of each row); rows of a batch beyond a shard's size start the next."""
    for batch in batches:
        first, parts, held = 0, [], 0
        for lo, words in word_hashes(batch.column(text_at)):
            for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()), lo):
                parts.append(words.hashes[a:b])
                held += b - a
                if held >= SHARD:
                    yield batch.slice(first, i + 1 - first), Shard(parts, depth), [len(p) for p in parts]
                    first, parts, held = i + 1, [], 0
        if parts:
            yield batch.slice(first, len(parts)), Shard(parts, depth), [len(p) for p in parts]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Spans (from, to) as one flat list of disjoint ones."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


LONGEST = "struct<words:long,doc_word:long,item:string,item_word:long>"
_LONGEST = pa.struct([("words", pa.int64()), ("doc_word", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])


def _mark(blocks: list, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shard, counts in shards(batches, 1, size):
            spans: dict[int, list] = {}
            names: dict[int, set] = {}
            best: dict[int, tuple] = {}
            for shared in blocks:
                items: Items = shared.value
                places, length, window, owners = occurrences(shard, items, size)
                if len(places):
                    doc, at = shard.place(places)
                    for d, a, n in set(zip(doc.tolist(), at.tolist(), length.tolist())):
                        spans.setdefault(d, []).append((a, a + n))
                    met: dict[int, list] = {}
                    for d, w in set(zip(doc.tolist(), window.tolist())):
                        met.setdefault(d, []).append(owners[w])
                    for d, parts in met.items():
                        names.setdefault(d, set()).update(items.names[o] for o in np.unique(np.concatenate(parts)).tolist())
                    for d, found in longest_of_texts(shard, items, size, places, length, window, owners).items():
                        best[d] = min(best.get(d, found), found, key=lambda m: (-m[0], *m[1:]))
                del items
                if len(blocks) > 1:
                    # the next reading loads it again, so that one block is held at a time
                    vars(shared).pop("_value", None)
            all_spans, all_names, all_best = [], [], []
            for i, (old, known, won) in enumerate(zip(*(rows.column(k).to_pylist() for k in (3, 4, 5)))):
                old = old or []
                all_spans.append(_merge(spans.get(i, []) + list(zip(old[::2], old[1::2]))))
                all_names.append(sorted(names.get(i, set()) | set(known or [])))
                found = [m for m in (best.get(i), won and tuple(won.values())) if m]
                all_best.append(dict(zip(_LONGEST.names, min(found, key=lambda m: (-m[0], *m[1:])))) if found else None)
            columns = [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(all_spans, pa.list_(pa.int64())), pa.array(all_names, pa.list_(pa.string())), pa.array(all_best, _LONGEST), *(rows.column(i) for i in range(6, rows.num_columns))]
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return run


def _marked(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, size: int, keep: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    base = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(LONGEST).alias("longest")]
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    if keep and rest:
        base.append(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
    out = docs.select(*base)
    blocks = load_items(bench, item_col, item_text_col)
    held: list = []
    while True:
        # blocks go to the workers as they are read; the driver's own copy is dropped
        shared = [_share(sc, block) for block in islice(blocks, BLOCKS)]
        if held and not shared:
            break
        if held:
            out = materialize(out, "marked")
            for one in held:
                one.unpersist()
        held = shared or [_share(sc, Items(np.zeros(0, np.uint64), np.zeros(1, np.int64), [], Shard([], None)))]
        out = out.mapInArrow(lean(_mark(held, size)), out.schema)
    return out.withColumn("n_hit", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")), lambda s: s["sum"]))


def _share(sc, block: Items):
    shared = sc.broadcast(block)
    vars(shared).pop("_value", None)
    return shared


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, spans (word ranges, flat), items (names, sorted as text), longest (the
    longest verbatim match of a window or more: words, doc_word, item, item_word; null without one).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased.  A window is ``size`` consecutive words of an item, or all words
    of a shorter item.  Null and empty texts have no words; null or empty items
    no window; a null item id reads as "".  Rows that repeat stay; empty tables
    give an empty table or rows without hits.
    """
    out = _marked(docs, bench, id_col, text_col, item_col, item_text_col, size, False)
    return out.select("doc_id", "n_words", "n_hit", "spans", "items", "longest")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13) -> DataFrame:
    """docs without its contaminated rows; columns as they were."""
    out = _marked(docs, bench, id_col, text_col, item_col, item_text_col, size, True).where(~is_contaminated())
    place = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return out.select(*(place.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 5) -> DataFrame:
    """(item_id, item_word, doc_id, doc_word, words): for each item suffix one longest verbatim match in docs of
    at least ``least`` words; of those found in different shards the longest, then that with the smallest doc_id and word.

    Each ``BLOCKS`` blocks of the benchmark are one pass over docs.
    """
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"item_id string, item_word long, doc_id {kind}, doc_word long, words long"
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [c.split()[0] for c in schema.split(", ")]

    def find(blocks: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, shard, _ in shards(batches, 1, None):
                for shared in blocks:
                    items: Items = shared.value
                    start = np.arange(len(items.hashes))
                    item = np.repeat(np.arange(len(items.names)), np.diff(items.bounds))
                    words, place = reach(shard, np.append(shard.translate(items.hashes), np.int32(1)), start, items.bounds[item + 1])
                    some = words >= least
                    doc, at = shard.place(place[some])
                    columns = [pa.array([items.names[i] for i in item[some].tolist()], pa.string()), pa.array((start - items.bounds[item])[some]), rows.column(0).take(pa.array(doc)), pa.array(at), pa.array(words[some])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    del items
                    if len(blocks) > 1:
                        vars(shared).pop("_value", None)

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    blocks = load_items(bench, item_col, item_text_col)
    while shared := [_share(sc, block) for block in islice(blocks, BLOCKS)]:
        part = base.mapInArrow(lean(find(shared)), schema)
        part = part.groupBy("item_id", "item_word").agg(F.min(F.struct(-F.col("words"), "doc_id", "doc_word")).alias("m"))
        out = out.union(materialize(part.select("item_id", "item_word", "m.doc_id", "m.doc_word", (-F.col("m.col1")).alias("words")), "matches"))
        for one in shared:
            one.unpersist()
    best = out.groupBy("item_id", "item_word").agg(F.min(F.struct(-F.col("words"), "doc_id", "doc_word")).alias("m"))
    return best.select("item_id", "item_word", "m.doc_id", "m.doc_word", (-F.col("m.col1")).alias("words"))
