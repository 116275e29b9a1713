"""URL filters by a sort-merge range join of reversed hosts with nested rules.

A host's canonical key is its labels in reverse, each closed by a dot, so
``example.com`` is ``com.example.`` and all its subdomains lie in the interval
from that key to the key followed by the largest character.  Intervals of rule
hosts are nested or apart.  Sorted URLs are swept along the sorted rule hosts;
a stack holds the hosts whose interval contains the URL, innermost on top, and
each host's path rules form intervals of their own that a bisection descends.
The innermost host with a fitting path wins, and there the longest path.

Rules are cut into blocks of at most ``block`` hosts in key order, each block
with the hosts that are open at its start.  One block (the usual case: its
size is counted) goes to all tasks and URLs aren't shuffled.  With several
blocks, URLs and rules meet by block number and a salt, so a host with a third
of all URLs is spread over ``salts`` tasks for each block.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; without a fitting rule the verdict is ``default``; rules with a
null or empty host fit nothing; of equal rules, block wins; repeated rows are
judged alike; empty tables of URLs give no rows, empty rules the default.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, replace_column

TOP = chr(0x10FFFF)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(host: str) -> str:
    """Reversed labels, each closed by a dot; empty for an empty host."""
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Host:
    """A rule host: its key and its path rules in order, each with the next shorter rule that starts it."""

    def __init__(self, key: str, rules: list[tuple[str, str, str]]):
        self.key, self.paths, self.rules, self.parent = key, [], [], []
        stack: list[int] = []
        for path, rule, verdict in sorted(rules, key=lambda r: (r[0], r[2] != "block", r[1])):
            if self.paths and self.paths[-1] == path:
                continue
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.parent.append(stack[-1] if stack else -1)
            stack.append(len(self.paths))
            self.paths.append(path)
            self.rules.append((rule, verdict))

    def find(self, path: str) -> tuple[str, str] | None:
        """The longest rule that the path starts with."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.parent[i]
        return self.rules[i] if i >= 0 else None


def hosts(rules: list[tuple[str, str, str]]) -> list[Host]:
    """Rule hosts in key order from (host, path, verdict) rules."""
    rows = sorted((canonical(h.lower()), p or "", f"{h.lower()}{p or ''}", v) for h, p, v in rules if h)
    return [Host(k, [r[1:] for r in g]) for k, g in groupby(rows, key=lambda r: r[0])]


def blocks(ordered: list[Host], size: int) -> list[list[Host]]:
    """Runs of at most ``size`` hosts, each led by the hosts that are open at its start."""
    out, stack = [], []
    for i, h in enumerate(ordered):
        while stack and not h.key.startswith(stack[-1].key):
            stack.pop()
        if i % size == 0:
            out.append(list(stack))
        stack.append(h)
        out[-1].append(h)
    return out or [[]]


def sweep(rules: list[Host], keys: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
    """The winning rule of each URL: one pass along sorted URLs and sorted rule hosts."""
    out: list[tuple[str, str] | None] = [None] * len(keys)
    stack: list[Host] = []
    at = 0
    for i in sorted(range(len(keys)), key=lambda i: (keys[i], paths[i])):
        key = keys[i]
        while at < len(rules) and rules[at].key <= key:
            while stack and not rules[at].key.startswith(stack[-1].key):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        for host in reversed(stack):
            if key and (found := host.find(paths[i])):
                out[i] = found
                break
    return out


def _judge(rules: list[Host], host: pa.Array, path: pa.Array, default: str) -> pa.StructArray:
    found = sweep(rules, [canonical(h or "") for h in host.to_pylist()], [p or "" for p in path.to_pylist()])
    return pa.StructArray.from_arrays([pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())], names=["rule", "verdict"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow", block: int = 50_000, salts: int = 64) -> DataFrame:
    """Adds host, path, rule and verdict to each row.

    ``rules`` are (host, path, verdict) rows; a table of rules is read to the
    driver, which holds only rules, never URLs.
    """
    rows = [tuple(r) for r in rules.select("host", "path", "verdict").toLocalIterator()] if isinstance(rules, DataFrame) else rules
    parts = blocks(hosts(rows), block)
    out = replace_column(replace_column(pages, "host", host_of(named(url))), "path", path_of(named(url)))
    if len(parts) == 1:
        own = parts[0]

        @F.arrow_udf("struct<rule:string,verdict:string>")
        def judge(host: pa.Array, path: pa.Array) -> pa.Array:
            return _judge(own, host, path, default)

        both = fresh("_judged", out)
        out = replace_column(out, both, judge("host", "path"))
        out = replace_column(out, "rule", F.col(f"{both}.rule"))
        return replace_column(out, "verdict", F.col(f"{both}.verdict")).drop(both)
    return _by_block(out, parts, default, salts)


def _by_block(urls: DataFrame, parts: list[list[Host]], default: str, salts: int) -> DataFrame:
    """The way for rules beyond one block: a shuffle by block and salt; a task holds one block at a time."""
    spark = urls.sparkSession
    firsts = [next(h.key for h in p if not any(h is o for o in q)) for p, q in zip(parts, [[], *parts], strict=False)]

    @F.arrow_udf("int")
    def number(host: pa.Array) -> pa.Array:
        return pa.array([max(0, bisect_right(firsts, canonical(h or "")) - 1) for h in host.to_pylist()], pa.int32())

    wanted = [c for c in urls.columns if c.lower() not in ("rule", "verdict")]
    left = urls.select(*map(named, wanted))
    block, salt = fresh("_block", left), fresh("_salt", left)
    told = [named(c) for c, t in left.dtypes if not t.startswith(("map", "variant"))]
    kinds = ", ".join("`" + c.replace("`", "``") + f"` {t}" for c, t in left.dtypes)
    # Rows that are equal in all columns are dealt by their place, too.
    left = left.withColumn(block, number("host")).withColumn(salt, F.pmod(F.xxhash64(*told, F.spark_partition_id()), F.lit(salts)).cast("int"))
    stored = spark.sparkContext.broadcast  # only a block's rules are sent, with the task that wants them
    shared = [stored(p) for p in parts]

    def judge(batches):
        for batch in batches:
            number_of = np.asarray(batch.column(block))
            order = pa.array(np.argsort(number_of, kind="stable"))
            batch = batch.take(order)
            number_of = np.asarray(batch.column(block))
            cut = [0, *(np.flatnonzero(np.diff(number_of)) + 1).tolist(), len(number_of)]
            for a, b in zip(cut, cut[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    judged = _judge(shared[int(number_of[a])].value, part.column("host"), part.column("path"), default)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in wanted), *judged.flatten()], names=[*wanted, "rule", "verdict"])

    schema = kinds + ", rule string, verdict string"
    return left.repartition(block, salt).sortWithinPartitions(block, "host", "path").mapInArrow(judge, schema)
