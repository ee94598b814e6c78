"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter for a packing, and there are at most ``capacity`` of them,
so the plan is made in count space: the histogram of lengths comes to the
driver (at most ``capacity`` rows, whatever the corpus), and a plan is a list
of patterns - multisets of lengths - with multiplicities.  For the longest
length left the gap to the capacity is looked up among the available single,
pair and triple sums; if none fills it exactly, the best-fitting length goes
in and the rest of the gap is looked up again.  A pattern is repeated as often
as the counts allow, so each pattern exhausts a length and the plan has at most
about ``capacity`` patterns.

Documents then find their place by rank: pieces of one length are numbered,
and the plan says which sequence and offset a number has.  Frequent lengths
are salted, so no task numbers more than about ``RANKED`` pieces of a length, or
a ``SALTS``-th of all pieces if that is more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseline.llm.tables import bound_batches, lean, materialize
from verseline.llm.token_counts import loaded, share, text_parts

#: pieces that a salt numbers at least, and salts of all lengths at most: what is broadcast of them does not grow
RANKED, SALTS = 256, 65_536


class Stock:
    """Available lengths with their counts; sums are indexed as bit sets that follow the counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.count = dict.fromkeys(range(capacity + 1), 0)
        self.bits = self.mirror = 0
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} is outside 1 to {capacity}")
            if n:
                self.change(length, n)

    def change(self, length: int, n: int) -> None:
        had = self.count[length]
        self.count[length] = had + n
        if bool(had) != bool(had + n):
            self.bits ^= 1 << length
            self.mirror ^= 1 << (self.capacity - length)

    def largest(self, most: int) -> int:
        """The longest available length up to ``most``, or 0."""
        return max(0, (self.bits & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if total > 0 and self.count[total] else None

    def pair(self, total: int, most: int | None = None) -> tuple[int, ...] | None:
        """Two available lengths with this sum, the longer as long as may be."""
        if total < 2:
            return None
        both = self.bits & (self.mirror >> (self.capacity - total))
        if most is not None:
            both &= (2 << most) - 1
        if total % 2 == 0 and self.count[total // 2] < 2:
            both &= ~(1 << (total // 2))
        long = both.bit_length() - 1
        return (long, total - long) if long >= total - long > 0 else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        first = self.largest(total - 2)
        while 3 * first >= total and first:
            self.change(first, -1)
            rest = self.pair(total - first, first)
            self.change(first, 1)
            if rest:
                return (first, *rest)
            first = self.largest(first - 1)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: pieces in each sequence})], using every piece exactly once."""
    stock = Stock(counts, capacity)
    out = []
    while longest := stock.largest(capacity):
        pattern: dict[int, int] = {}

        def take(lengths: tuple[int, ...], pattern=pattern) -> int:
            for x in lengths:
                pattern[x] = pattern.get(x, 0) + 1
                stock.change(x, -1)
            return sum(lengths)

        gap = capacity - take((longest,))
        while gap:
            exact = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            if exact:
                take(exact)
                break
            fit = stock.largest(gap)
            if not fit:
                break
            gap -= take((fit,))
        times = 1 + min(stock.count[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            stock.change(x, -n * (times - 1))
        out.append((times, pattern))
    return out


def slots(planned: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each sequence, offset), by length and first rank."""
    rows, used, sequence = [], {}, 0
    for times, pattern in planned:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, row_key, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut into
    pieces of ``capacity``; a null text is empty and gives the end id alone."""
    bound_batches(docs.sparkSession)
    shared = share(docs, path, text_col)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path, shared)
        for batch in batches:
            for at, part in text_parts(batch.column(2)):
                row, piece, length, crc, ids = [], [], [], [], []
                found, bounds = encoder.ids(part)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), at):
                    raw = found[a:b].tobytes() + end
                    for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        one = raw[lo : lo + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        length.append(len(one) >> 2)
                        crc.append(zlib.crc32(one))
                        if keep_ids:
                            ids.append(one)
                pick = pa.array(row, pa.int64())
                columns = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if keep_ids else []), names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(run), f"doc_id {kind}, row_key long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (length, row_key, piece)."""
    spark = cut.sparkSession
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    where = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    each = max(RANKED, sum(histogram.values()) // SALTS)
    parts = spark.createDataFrame([(k, -(-n // each)) for k, n in histogram.items()], "length long, parts long")
    salted = cut.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("row_key", "piece"), "parts")).drop("parts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_key", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "salt")
    names = [c for c in ranked.columns if c != "nth"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "nth") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        key = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            length, nth = at["length"].to_numpy(), at["nth"].to_numpy()
            slot = table[np.searchsorted(key, length << 48 | nth, "right") - 1]
            step, rest = np.divmod(nth - slot[:, 1], slot[:, 3])
            yield pa.RecordBatch.from_arrays([at[c] for c in names] + [pa.array(slot[:, 2] + step), pa.array(slot[:, 4] + rest * length)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(run), schema)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian 32-bit, if kept).

    Only texts of more than ``capacity`` ids, the end id included, are cut.
    Null and empty texts are the end id alone; rows that repeat an id are packed
    each; an empty table gives an empty table.
    """
    if capacity < 1 or capacity > 1 << 15:
        raise ValueError("capacity must be 1 to 32768")
    cut = materialize(pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    return place(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
