"""URL allow / block lists over a trie of reversed host labels and path segments.

A rule is (verdict, host, path).  It fits its host and all subdomains if the
URL's path starts with the rule's path.  The trie's edges are first the host
labels from the right, then the path's segments; a rule whose path ends inside
a segment hangs its rest there as a prefix.  The longest fitting rule wins,
whatever its verdict.  Longer means more host labels first, then more characters
of path, as a rule for a subdomain is made by who runs it.

The trie is built once, on the driver, and broadcast; ``MAX_RULES`` and
``MAX_CHARS`` bound it.  For a longer list ``judge`` splits the rules into blocks
and joins nothing: each block is broadcast in a pass of its own, with the result
so far written in between, and the longer match of two blocks is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.tables import bound_batches, fresh, lean, materialize

#: rules of a block, and characters in them: a trie of some 150 MB at most
MAX_RULES, MAX_CHARS = 200_000, 1 << 25


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host is what follows the first '://' up to '/', '?', '#' or the end,
    with A-Z lower-cased; the path goes on from there up to '?', '#' or the end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_FOLD), path


_FOLD = {c: c + 32 for c in range(65, 91)}


class Trie:
    """Rules by reversed host labels, then path segments.

    Nodes are numbers and edges one table, so that it can be broadcast however
    deep it is.  A node's ends are rests of a segment: a rule fits if the next
    segment starts with its rest.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.labels: dict[tuple[int, str], int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        self.ends: dict[int, dict[str, Rule]] = {}
        count = 1
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {rule.verdict!r}")
            node = 0
            *whole, rest = rule.path.split("/")
            for edges, steps in ((self.labels, reversed(rule.host.translate(_FOLD).split(".")) if rule.host else ()), (self.segments, whole)):
                for step in steps:
                    at = edges.setdefault((node, step), count)
                    count += at == count
                    node = at
            self.ends.setdefault(node, {}).setdefault(rest, rule)
        #: lengths of each node's rests, the longest first
        self.sizes = {node: sorted({len(rest) for rest in ends}, reverse=True) for node, ends in self.ends.items()}

    def _along_path(self, node: int, segments: list[str]) -> Rule | None:
        """The rule with the longest path below a host's node."""
        best = None
        for segment in segments:
            for size in self.sizes.get(node, ()):
                if size <= len(segment) and (rule := self.ends[node].get(segment[:size])):
                    best = rule
                    break
            node = self.segments.get((node, segment))
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits: more host labels first, then the longer path."""
        segments = path.split("/")
        node, best = 0, self._along_path(0, segments)
        for label in reversed(host.split(".")) if host else ():
            node = self.labels.get((node, label))
            if node is None:
                break
            best = self._along_path(node, segments) or best
        return best


def _rank(rule: Rule) -> int:
    return (len(rule.host.split(".")) if rule.host else 0) * (1 << 20) + len(rule.path)


def judge(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule ('host' + 'path' of the winner, null if none) and verdict.

    Null URLs and those without '://' have an empty host and path; with no
    fitting rule the verdict is ``default``.  Columns of df that clash with the
    new ones are replaced.  Of two rules equally long the first listed wins.
    Repeated rows stay; an empty table gives an empty table, and no rules leave
    the default.
    """
    bound_batches(df.sparkSession)
    if default not in ("allow", "block"):
        raise ValueError("default must be allow or block")
    blocks: list[list[Rule]] = [[]]
    chars = 0
    for rule in dict.fromkeys(rules):
        chars += len(rule.host) + len(rule.path)
        if blocks[-1] and (len(blocks[-1]) == MAX_RULES or chars > MAX_CHARS):
            blocks.append([])
            chars = len(rule.host) + len(rule.path)
        blocks[-1].append(rule)
    spark = df.sparkSession
    keep = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url_col]
    (rank,) = fresh(df, "rule_rank")
    out = df.select(*keep).withColumns({"host": F.lit(""), "path": F.lit(""), "rule": F.lit(None).cast("string"), "verdict": F.lit(default), rank: F.lit(-1)})
    for i, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(Trie(block))
        out = out.mapInArrow(lean(_judge(shared, url_col, rank)), out.schema)
        if i + 1 < len(blocks):
            out = materialize(out, "judged")
            shared.unpersist()
    return out.drop(rank)


def _judge(shared, url_col: str, rank_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = shared.value
        for batch in batches:
            names = batch.schema.names
            hosts, paths, found, verdicts, ranks = [], [], [], [], []
            held = [batch.column(names.index(c)).to_pylist() for c in ("rule", "verdict", rank_col)]
            for url, rule, verdict, rank in zip(batch.column(names.index(url_col)).to_pylist(), *held):
                host, path = split_url(url)
                best = trie.match(host, path)
                if best is not None and _rank(best) > rank:
                    rule, verdict, rank = best.host + best.path, best.verdict, _rank(best)
                hosts.append(host)
                paths.append(path)
                found.append(rule)
                verdicts.append(verdict)
                ranks.append(rank)
            new = {"host": hosts, "path": paths, "rule": found, "verdict": verdicts}
            columns = [pa.array(new[c], pa.string()) if c in new else pa.array(ranks, pa.int32()) if c == rank_col else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
