"""Allow and block lists of hosts and paths, judged with one trie.

The trie's edges are host labels from the right, then path segments. A rule ends at a node; one
that stops inside a segment hangs on the node before it as a prefix. A url walks the trie once
and the deepest rule on its way wins, whether it allows or blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import arrow_column, struct_of, without

#: (host, path, verdict); the rules of the query that the contract fixes.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Rules the broadcast trie may hold, a few hundred bytes each; beyond, the urls meet the rules in a join.
MOST_BROADCAST = 200_000
JUDGED = "struct<host:string,path:string,rule:string,verdict:string>"
PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: A-Z of the host lower-cased; both empty without a ``://``."""
    found = PARTS.search(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


class Trie:
    """Nodes are dicts: edges by label or segment; "" is never an edge of a host label of a rule."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root = _Node()
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(UPPER).split(".")) if host else ():
                node = node.host.setdefault(label, _Node())
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.path.setdefault(segment, _Node())
            node.ends[rest] = min((f"{host.translate(UPPER)}{path}", verdict), node.ends.get(rest, ("\U0010ffff", "")))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict: the rule with most host labels, among those with the longest path."""
        node, best = self.root, self.root.match(path)
        for label in reversed(host.split(".")) if host else ():
            node = node.host.get(label)
            if node is None:
                break
            best = node.match(path) or best
        return best


class _Node:
    __slots__ = ("host", "path", "ends")

    def __init__(self) -> None:
        self.host: dict[str, _Node] = {}
        self.path: dict[str, _Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}

    def match(self, path: str) -> tuple[str, str] | None:
        """The longest path rule below this host that the path starts with."""
        node, best, at = self, None, 0
        while node is not None:
            if node.ends:
                fits = [rest for rest in node.ends if path.startswith(rest, at)] if len(node.ends) < 8 else \
                    [path[at:at + n] for n in sorted({len(r) for r in node.ends}) if path[at:at + n] in node.ends]
                if fits:
                    best = node.ends[max(fits, key=len)]
            slash = path.find("/", at)
            if slash < 0:
                break
            node, at = node.path.get(path[at:slash]), slash + 1
        return best


def _judge(shared, default: str):
    def judge(urls: pa.Array) -> pa.Array:
        trie, hosts, paths, rules, verdicts = shared.value, [], [], [], []
        for url in urls.to_pylist():
            host, path = split_url(url)
            rule, verdict = trie.longest(host, path) or (None, default)
            hosts.append(host)
            paths.append(path)
            rules.append(rule)
            verdicts.append(verdict)
        return struct_of(host=(hosts, pa.string()), path=(paths, pa.string()), rule=(rules, pa.string()), verdict=(verdicts, pa.string()))
    return judge


def _joined(pages: DataFrame, rules: DataFrame, default: str, url: str) -> DataFrame:
    """The same verdicts for rule tables of any size: each distinct host and path asks, for each of
    its host suffixes, the rules of that host in a join; the best rule goes back to the urls."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    split = pages.withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, -i, i)))))
    # a rule names whole segments and a rest; the whole segments are a key both sides can meet on
    whole = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/", -1)) - 1), lambda n: F.concat_ws("/", F.slice(F.split("path", "/", -1), 1, n)))
    asked = (split.select("host", "path").distinct().select("host", "path", F.posexplode(suffixes).alias("depth", "of_host"))
             .select("host", "path", "depth", "of_host", F.posexplode(whole).alias("segments", "of_path")))
    parts = F.split(F.col("path"), "/", -1)
    known = rules.select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("of_host"), F.col("path").alias("prefix"), "verdict",
        (F.size(parts) - 1).alias("segments"), F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1)).alias("of_path"))
    best = (asked.join(known, ["of_host", "of_path", "segments"]).where(F.col("path").startswith(F.col("prefix")))
            .groupBy("host", "path").agg(F.min_by(F.struct(F.concat("of_host", "prefix").alias("rule"), "verdict"),
                                                  F.struct(-F.col("depth"), -F.length("prefix"), F.concat("of_host", "prefix"), "verdict")).alias("best")))
    return split.join(best, ["host", "path"], "left").select(
        *pages.columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", url: str = "url",
               most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The pages with host, path, rule (null where none fits) and verdict.

    A rule (host, path, verdict) fits its host and all subdomains, if the url's path starts with
    the rule's. More host labels win, then the longer path, then the lesser rule text and verdict.
    ``default`` is the verdict without a rule. Null urls and urls without ``://`` have an empty host and path.
    Input columns named like the new ones are replaced; every row stays, repeated ones too.

    ``rules`` may be a table with columns host, path, verdict: up to ``most_broadcast`` rules make
    a broadcast trie, more are joined.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
        if rules.limit(most_broadcast + 1).count() > most_broadcast:
            return _joined(pages, rules, default, url)
        rules = [tuple(r) for r in rules.collect()]
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    judged: Column = arrow_column(_judge(shared, default), JUDGED, F.col(url).cast("string"))
    return pages.withColumn("_judged", judged).select(*[F.col(f"`{c}`") for c in pages.columns], "_judged.*")
