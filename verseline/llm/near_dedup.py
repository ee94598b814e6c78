"""MinHash near-duplicate grouping with SuperMinHash.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text's
set holds its distinct word shingles.  Two texts are linked if their sets'
Jaccard similarity reaches the threshold; groups are the connected components
of all links, rows of one id being one node.

Plan, each step a table in the shared folder:

1. one pass over the texts gives set size, a 128-bit fingerprint of the set and
   one key per band of its SuperMinHash signature;
2. equal sets collapse to their smallest id (pre-aggregated, so a set that
   makes up a third of all rows is one row from here on);
3. buckets of equal band keys are star-joined: every member against the
   bucket's smallest id, never all pairs.  The members of a star are dealt over
   tasks by pivot and salt, each with one copy of the pivot's set, and are
   confirmed on the full sets;
4. in buckets that still hold several components those members that are not in
   the bucket's largest one are compared with all others, in blocks of bounded
   size, over an inverted index of the full sets.  Only a spanning forest of the
   links between components leaves a task;
5. union-find grouping: each partition contracts its edges with a union-find,
   then large-star / small-star rounds join the forests of all partitions.

Full sets travel as 64-bit hashes of their shingles.  With 32 bands of 4 rows a
pair at similarity 0.8 shares no band with probability 5e-8; that is the
method's only loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm import superminhash
from verseline.llm.tables import bound_batches, fresh, lean, materialize
from verseline.llm.text_scan import NOT_SPACE, Words, mix64, shingles, slices, strings

#: members of a star that are dealt to one task at once
STAR = 64
#: members of a block's side that meet in one task, and their shingles
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: large stars that are broadcast at most (some 10 MB)
MOST_STARS = 200_000
MAX_ROUNDS = 60
#: nodes that a union-find of one partition holds before it starts anew
CONTRACTED = 500_000


def text_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of the rows from there on), slice by slice."""
    data, offsets = strings(column)
    for lo, hi in slices(offsets):
        yield lo, shingles(Words(data, offsets[lo : hi + 1], NOT_SPACE), size)


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, the same for equal sets whatever the order."""
    salt = np.uint64(0xD6E8FEB86659FD93)
    one = np.array([mix64(s ^ salt).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    two = np.array([mix64(s + salt).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _sketch(size: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in text_sets(batch.column(1), size):
                one, two = _fingerprints(sets)
                keys = superminhash.bands(superminhash.signatures(sets, n_bands * rows), rows).view(np.int64)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(one),
                        pa.array(two),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "keys"],
                )

    return run


def _full_sets(size: int):
    """Each text's first fingerprint and its set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in text_sets(batch.column(1), size):
                one, _ = _fingerprints(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array(one), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "print", "hashes"])

    return run


def _read_sets(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = strings(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield np.frombuffer(data[a:b].tobytes(), np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, are linked; empty ones are with nothing."""
    few, many = sorted((len(a), len(b)))
    if not few or 100 * few < percent * many:
        return False
    both = np.concatenate((a, b))
    both.sort()
    return bool(linked(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent))


def _confirm_stars(percent: int):
    """Rows (pivot, pivot_print, salt, member, hashes), each group's pivot first (member null), to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, center = None, np.zeros(0, np.uint64)
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            members = batch.column(3).to_pylist()
            a, b = [], []
            for k, member, one in zip(keys, members, _read_sets(batch.column(4))):
                if member is None:
                    key, center = k, one
                elif k == key and similar(center, one, percent):
                    a.append(k[0])
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class Forest:
    """Union-find over any hashable nodes; the smaller root wins."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        parent = self.parent
        lo, hi = (a, b) if a < b else (b, a)
        parent[hi] = lo
        parent.setdefault(lo, lo)
        return True


def forest_links(roots: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of roots whose components are linked: a spanning forest of all links between a row that asks and one that does not.

    Each asking row meets all others over an inverted index of these, so no link between components is missed.
    """
    label = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    targets = np.flatnonzero(~asks)
    if not len(targets):
        return []
    values, token = np.unique(np.concatenate([sets[t] for t in targets]), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting, first = np.repeat(targets, sizes[targets])[order], np.searchsorted(token[order], np.arange(len(values) + 1))
    out = []
    for x in np.flatnonzero(asks).tolist():
        if (label[targets] == label[x]).all():
            continue
        at = np.searchsorted(values, sets[x])
        at = at[values[np.minimum(at, len(values) - 1)] == sets[x]]
        spans = [posting[first[t] : first[t + 1]] for t in at.tolist()]
        if not spans:
            continue
        shared = np.bincount(np.concatenate(spans), minlength=len(sets))
        for y in np.flatnonzero(linked(shared, sizes[x], sizes, percent) & (shared > 0) & (label != label[x])).tolist():
            if label[y] != label[x]:
                out.append((int(roots[x]), int(roots[y])))
                label[label == label[y]] = label[x]
    return out


def _finish(percent: int):
    """Rows (key, i, j, root, asks, hashes), sorted by block, to links (a, b) between roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> pa.RecordBatch | None:
            if len({r[0] for r in held}) < 2:
                return None
            roots, asks = (np.array([r[i] for r in held], np.int64) for i in range(2))
            found = forest_links(roots, asks.astype(bool), [r[2] for r in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"]) if found else None

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            rows = zip(*(batch.column(i).to_pylist() for i in (3, 4)), _read_sets(batch.column(5)))
            for k, row in zip(keys, rows):
                if k != key:
                    if held and (out := done()) is not None:
                        yield out
                    held.clear()
                    key = k
                held.append(row)
        if held and (out := done()) is not None:
            yield out

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as the stars of its union-find; a large partition gives several forests."""

    def stars(forest: Forest) -> Iterator[pa.RecordBatch]:
        nodes = [x for x in forest.parent if forest.find(x) != x]
        for lo in range(0, len(nodes), 50_000):
            part = nodes[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.find(x) for x in part], pa.int64())], names=["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
        if len(forest.parent) > CONTRACTED:
            yield from stars(forest)
            forest = Forest()
    yield from stars(forest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of edges (a, b) the smallest node that it reaches, roots left out.

    Partitions contract what they hold with a union-find; then each round runs
    a large-star and a small-star step.  It is over when no large-star step moves
    an edge and every node has one edge left, to its root.
    """
    # a > b in each row
    current = materialize(edges.mapInArrow(lean(_contract), "a long, b long").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = current.select(F.col("b").alias("a"), F.col("a").alias("over")).join(least, "a")
        large = materialize(large.select(F.col("over").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("a")).alias("moved")), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("top"), F.max("moved").alias("moved")), "low")
        if not low.agg(F.max(F.col("moved") | (F.col("m") != F.col("top")))).first()[0]:
            return low.select(F.col("a").alias("node"), F.col("m").alias("root"))
        small = large.join(low.select("a", "m"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        current = materialize(small.where("a <> b").distinct(), "edges")
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def _star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of bucket members with their bucket's pivot, each pair confirmed once."""
    pivot = ["pivot", "pivot_print"]
    pairs = members.where("rep <> pivot or print <> pivot_print").where(F.lit(100) * F.least("n", "pivot_n") >= F.lit(percent) * F.greatest("n", "pivot_n"))
    pairs = materialize(pairs.select(*pivot, "rep", "print").distinct(), "pairs")
    # large stars are dealt over several tasks; their list is short enough to broadcast
    sizes = materialize(pairs.groupBy(*pivot).agg(F.count("*").alias("n")).where(F.col("n") > STAR), "stars")
    least = STAR
    while sizes.where(F.col("n") > least).count() > MOST_STARS:
        least *= 4
    large = sizes.where(F.col("n") > least).select(*pivot, F.ceil(F.col("n") / STAR).cast("int").alias("salts"))
    dealt = pairs.join(F.broadcast(large), pivot, "left").withColumn("salt", F.pmod(F.xxhash64("rep", "print"), F.coalesce("salts", F.lit(1))).cast("int"))
    there = dealt.join(sets, ["rep", "print"]).select(*pivot, "salt", F.col("rep").alias("member"), "hashes")
    centers = dealt.select(*pivot, "salt").distinct().join(sets.withColumnsRenamed({"rep": "pivot", "print": "pivot_print"}), pivot)
    both = there.unionByName(centers.select(*pivot, "salt", F.lit(None).cast("long").alias("member"), "hashes"))
    both = both.repartition(*pivot, "salt").sortWithinPartitions(*pivot, "salt", F.col("member").asc_nulls_first())
    return both.mapInArrow(lean(_confirm_stars(percent)), "a long, b long")


def _block_links(members: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the roots of components that a bucket's members are still in.

    A bucket's pivot has met all members; of the others those outside of the
    bucket's largest component ask all the rest.
    """
    rooted = members.where("rep <> pivot or print <> pivot_print").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "print", "n", F.coalesce("root", "rep").alias("root"))
    held = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n").alias("s"), F.sum(F.xxhash64("rep", "print").cast("decimal(38,0)")).alias("who"))
    held = held.groupBy("key").agg(F.max(F.struct("n", "root", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("who").alias("who")).where("n > top.n")
    parts = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    # buckets of the same members need be finished once
    held = held.groupBy("n", "who").agg(F.min(F.struct("key", F.col("top.root").alias("main"), parts(F.col("n"), F.col("s")).alias("blocks"), parts(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("asking"))).alias("b"))
    mixed = materialize(held.select("b.*"), "mixed")
    near = rooted.join(mixed, "key").join(sets, ["rep", "print"])
    at = lambda n: F.pmod(F.xxhash64("rep", "print"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    told = F.transform(every("asking"), lambda i: F.struct(i.alias("i"), at("blocks").alias("j"), F.lit(0).alias("asks")))
    ask = F.transform(every("blocks"), lambda j: F.struct(at("asking").alias("i"), j.alias("j"), F.lit(1).alias("asks")))
    near = near.withColumn("at", F.explode(F.concat(told, F.when(F.col("root") != F.col("main"), ask).otherwise(F.slice(ask, 1, 0)))))
    near = near.select("key", "at.i", "at.j", "root", "at.asks", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "asks", "root")
    return near.mapInArrow(lean(_finish(percent)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, n_bands: int = 32, rows: int = 4) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Texts with fewer than ``size`` words are one shingle; empty or null texts
    have none and link with nothing.  A row whose id is null links with nothing
    and is kept, with a null component.  Rows that repeat an id are one document:
    the links of all their texts are its links, and they share a component and are
    kept or not together.  An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = materialize(base.mapInArrow(lean(_sketch(size, n_bands, rows)), "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>"), "sketches")
    prints = ["print_a", "print_b", "n_shingles"]
    alive = sig.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(alive.groupBy(*prints).agg(F.min(F.struct("doc_id", "keys")).alias("m")).select(*prints, F.col("m.doc_id").alias("rep"), "m.keys"), "reps")
    # from here on a set is known by its smallest id and its first fingerprint
    rows_of = reps.select("rep", F.col("print_a").alias("print"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    buckets = rows_of.groupBy("key").agg(F.min(F.struct("rep", "print", "n")).alias("p"), F.count("*").alias("many")).where("many > 1")
    buckets = materialize(buckets.select("key", F.col("p.rep").alias("pivot"), F.col("p.print").alias("pivot_print"), F.col("p.n").alias("pivot_n")), "buckets")
    members = materialize(rows_of.join(buckets, "key"), "members")
    needed = base.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = materialize(needed.mapInArrow(lean(_full_sets(size)), "rep long, print long, hashes binary").groupBy("rep", "print").agg(F.first("hashes").alias("hashes")), "sets")

    links = _star_links(members, sets, percent)
    # ids with several texts tie these texts' groups together
    several = materialize(sig.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*prints)).alias("lo"), F.max(F.struct(*prints)).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    if not several.isEmpty():
        ties = alive.select("doc_id", *prints).join(several, "doc_id").join(reps.select(*prints, "rep"), prints)
        links = links.union(ties.where("doc_id <> rep").select("rep", "doc_id").distinct())
    found = components(links)
    more = materialize(_block_links(members, sets, found, percent), "more")
    if not more.isEmpty():
        # only roots are joined here, so this graph is far smaller than the first
        above = materialize(components(more), "above")
        moved = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = found.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(above)

    out = sig.join(reps.select(*prints, "rep"), prints, "left")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    out = out.select("doc_id", "n_shingles", node.alias("node")).join(found, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest id.

    Rows are what is grouped here, not ids: where rows repeat an id with different
    texts, those beyond the first of them stand for documents of their own, after
    all others, so a unique text stays whatever its id.  Rows that repeat both id
    and text are one document and one of them stays.  Rows without an id and empty
    texts stay.  An empty table gives an empty table.
    """
    text_key, node, n = fresh(docs, "text_key", "node", "n")
    keyed = docs.withColumn(text_key, F.xxhash64(F.col(f"`{text_col}`")))
    seen = keyed.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col), F.col(text_key)).agg(F.count("*").alias(n))
    seen = materialize(seen.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_key).alias("text_key"), F.col(n).alias("n")), "seen")
    counted = seen.groupBy("doc_id").agg(F.count("*").alias("texts"), F.min("text_key").alias("first"), F.max("n").alias("n")).where("texts > 1 or n > 1")
    again = materialize(counted, "again")
    if not again.isEmpty():
        top = seen.agg(F.max("doc_id")).first()[0]
        extra = seen.join(again.select("doc_id", "first"), "doc_id").where("text_key <> first")
        extra = materialize(extra.select("doc_id", "text_key", (F.lit(top + 1) + F.monotonically_increasing_id()).alias("node")), "extra")
        extra = extra.select(F.col("doc_id").alias(id_col), F.col("text_key").alias(text_key), F.col("node").alias(node))
        ids = again.select(F.col("doc_id").alias(id_col))
        plain = keyed.join(ids, id_col, "left_anti").withColumn(node, F.col(id_col))
        twice = keyed.join(ids, id_col, "left_semi").dropDuplicates([id_col, text_key])
        twice = twice.join(extra, [id_col, text_key], "left").withColumn(node, F.coalesce(node, id_col))
        keyed = materialize(plain.unionByName(twice), "keyed")
    else:
        keyed = keyed.withColumn(node, F.col(id_col))
    groups = near_duplicates(keyed.select(F.col(node).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), size=size, percent=percent)
    copies = materialize(groups.where(~F.col("kept")).select(F.col("doc_id").alias(node)), "copies")
    return keyed.join(copies, node, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
