"""URL block and allow lists, matched with a trie.

The trie's edges are the host's labels from the right, then the path's
segments; a rule ends at a node, with the rest of its path that does not fill
a whole segment kept there by its text.  A rule fits its host and every
subdomain when the path of the url starts with the rule's path.  The longest
fitting rule (host and path together) wins; of equally long ones that with the
longer host, and of equal rules ``block``.

Host and path are cut out by built-in functions, only the look-up is Python.
The rule list is operator-supplied and broadcast; MAX_RULES bounds it.

Defined results: a null url or one without ``://`` has an empty host and path;
no rule fits an empty host, unless its own host is empty.  Repeated rows get
the same answer each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


class UrlTrie:
    """Nodes are dicts: labels and segments to nodes; the key None holds {rest of path: (rule, verdict)} of the rules that end there, and their lengths."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            held, lengths = node.setdefault(None, ({}, set()))
            lengths.add(len(rest))
            if held.get(rest, (None, "allow"))[1] != "block":
                held[rest] = host + path, verdict

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        """The longest rule of a host's node: the deeper, the longer."""
        best = None
        for i, segment in enumerate(segments):
            if None in node:
                held, lengths = node[None]
                fits = [n for n in lengths if n <= len(segment) and segment[:n] in held]
                best = held[segment[: max(fits)]] if fits else best
            if i == len(segments) - 1 or (node := node.get(("p", segment))) is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            found = self._in_path(node, segments)
            if found and (best is None or len(found[0]) >= len(best[0])):
                best = found
        return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced.

    rules: (``allow`` or ``block``, host, path).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
    held = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = held.value
        for hosts, paths in batches:
            yield pd.DataFrame([trie.match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"], dtype=object)

    new = ("host", "path", "rule", "verdict")
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in new] or [F.lit(None).alias("_none")])
    host, path = split_url(F.col(url))
    found = pages.select(row.alias("row"), host.alias("host"), path.alias("path")).select("*", judge("host", "path").alias("judged"))
    return found.select(*[F.col(f"row.`{c}`") for c in pages.columns if c not in new], "host", "path", "judged.rule", "judged.verdict")
