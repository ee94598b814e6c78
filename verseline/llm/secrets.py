"""Secret scans with corpus-wide ownership frequency.

Candidates are found per text, and their values are hashed.  Over the whole
corpus each hash counts the distinct repositories and owners it appears in;
a value that many of them hold is a copied example, one that few hold looks
live.  The verdict is a span of its own beside the base span.

Only hashes, places and repository names are shuffled, never texts.  Counting
is two-level (distinct per hash and owner before per hash), so a value that a
third of all rows carry is pre-aggregated where it is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.tables import bound_batches, lean, materialize

#: fixed values: the base patterns, in their order
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key", "jwt", "live", "example")
#: what a text must hold, lower-cased, for an assignment to be there
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: kinds that only the method adds: private key blocks and signed tokens
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,40}PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
ADDED_HINTS = ("-----BEGIN ", "eyJ")


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value) of all candidates, by start and then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if ADDED_HINTS[0] in text:
        out += [(m.start(), 3, m.end(), m[0]) for m in KEY_BLOCK.finditer(text)]
    if ADDED_HINTS[1] in text:
        out += [(m.start(), 4, m.end(), m[0]) for m in JWT.finditer(text)]
    out.sort(key=lambda c: c[:3])
    return out


SPAN = "struct<start:int,kind:int,end:int,hash:string>"


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(doc_id, repo, owner, row_key, spans): all candidates of each row; values only as SHA-256.

    row_key tells rows apart that share a doc_id.
    """
    bound_batches(docs.sparkSession)
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = []
                for text in part.column(4).to_pylist():
                    found.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in find(text)] if text else [])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(4)] + [pa.array(found, pa.list_(span))], names=["doc_id", "repo", "owner", "row_key", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(run), f"doc_id {kind}, repo string, owner string, row_key long, spans array<{SPAN}>")


#: places from which on a value is hot, and how many hot values are broadcast at most (some 10 MB)
HOT, MOST_HOT = 10_000, 100_000


def ownership(found: DataFrame, most_owners: int) -> DataFrame:
    """(hash, places, repos, owners, live) over the whole corpus; a null repository or owner counts as one of its own."""
    each = found.select(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"), F.explode("spans.hash").alias("hash"))
    each = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("places"))
    each = each.groupBy("hash").agg(F.sum("places").alias("places"), F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    return each.withColumn("live", F.col("owners") <= most_owners)


def _with_verdict(each: DataFrame, status: DataFrame) -> DataFrame:
    """each (row_key, start, kind, end, hash) with its hash's live."""
    least = HOT
    while status.where(F.col("places") > least).count() > MOST_HOT:
        least *= 4
    hot = F.broadcast(status.where(F.col("places") > least).select("hash", "live"))
    rest = status.where(F.col("places") <= least).select("hash", "live")
    cold = each.join(hot.select("hash"), "hash", "left_anti").join(rest, "hash")
    return cold.unionByName(each.join(hot, "hash"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source", most_owners: int = 1) -> DataFrame:
    """Per row of docs: doc_id and spans, an array of (start, kind, end, hash) sorted by start and kind.

    Each candidate is followed by a span of kind 'live' (held by at most
    ``most_owners`` owners) or 'example' over the same place.  Null texts read as
    empty; empty tables give empty tables; rows that repeat an id stay rows.
    """
    found = materialize(candidates(docs, id_col, text_col, repo_col, owner_col), "candidates")
    some = found.where(F.size("spans") > 0)
    status = materialize(ownership(some, most_owners).select("hash", "places", "live"), "ownership")
    each = some.select("row_key", F.explode("spans").alias("s")).select("row_key", "s.*")
    each = _with_verdict(each, status)
    live, example = (F.lit(KINDS.index(k)) for k in ("live", "example"))
    verdict = F.struct("start", F.when(F.col("live"), live).otherwise(example).cast("int").alias("kind"), "end", "hash")
    marks = each.groupBy("row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.struct("start", "kind", "end", "hash"), verdict))))).alias("all_spans"))
    out = found.select("doc_id", "row_key", "spans").join(marks, "row_key", "left")
    return out.select("doc_id", F.coalesce("all_spans", "spans").alias("spans"))


def joined(spans: str, base_only: bool = False):
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if base_only else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
