"""URL filters: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import built, map_rows

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
END_OF_HOST = re.compile(r"[/?#]")
END_OF_PATH = re.compile(r"[?#]")


class Rule(NamedTuple):
    """``path`` is empty (any path) or starts with a slash."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """``example.com/en/7`` as host and path prefix."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(ASCII_LOWER), slash + path)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = END_OF_HOST.search(rest)
    if end is None:
        return rest.translate(ASCII_LOWER), ""
    host, rest = rest[: end.start()], rest[end.start() :]
    return host.translate(ASCII_LOWER), END_OF_PATH.split(rest, maxsplit=1)[0]


class _Path:
    """A node of the path trie. A rule's last segment is a prefix of the url's, so it is kept apart."""

    __slots__ = ("below", "ends")

    def __init__(self):
        self.below: dict[str, _Path] = {}
        self.ends: dict[str, Rule] = {}


class _Host:
    __slots__ = ("any_path", "below", "paths")

    def __init__(self):
        self.below: dict[str, _Host] = {}
        self.any_path: Rule | None = None
        self.paths: _Path | None = None


def _rank(rule: Rule) -> tuple:
    """Longest rule first; of equal length the longer host, then block."""
    return len(rule.text), len(rule.host), rule.verdict == "block"


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Host()
        for rule in rules:
            self._add(rule)

    def _add(self, rule: Rule) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")):
            node = node.below.setdefault(label, _Host())
        if not rule.path:
            node.any_path = max(filter(None, (node.any_path, rule)), key=_rank)
            return
        node.paths = at = node.paths or _Path()
        *whole, last = rule.path[1:].split("/")
        for segment in whole:
            at = at.below.setdefault(segment, _Path())
        at.ends[last] = max(filter(None, (at.ends.get(last), rule)), key=_rank)

    def find(self, host: str, path: str) -> Rule | None:
        """The rule of the highest rank that fits host and path."""
        fits = []
        segments = path[1:].split("/") if path else []
        node = self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.any_path:
                fits.append(node.any_path)
            at = node.paths
            for segment in segments:
                if at is None:
                    break
                fits.extend(rule for end, rule in at.ends.items() if segment.startswith(end)) if len(at.ends) <= len(segment) + 1 else fits.extend(
                    at.ends[segment[:n]] for n in range(len(segment) + 1) if segment[:n] in at.ends
                )
                at = at.below.get(segment)
        return max(fits, key=_rank, default=None)


def url_filter(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_trie_rules: int = 500_000,
    max_trie_chars: int = 50_000_000,
) -> DataFrame:
    """Judge every url: id, url, host, path, rule (null: none fits) and verdict.

    ``rules`` is a list of `Rule` or a DataFrame (verdict, host, path). A rule fits its host and
    all subdomains where the url's path starts with the rule's path; the longest rule wins, then
    the one with the longer host, then block. A-Z of a rule's host are lower-cased and its path gets
    a leading slash where it lacks one; a null path fits every path, and rules of null verdict or
    host are left out. Up to ``max_trie_rules`` rules of ``max_trie_chars`` characters in all the
    trie is broadcast; a larger table of rules is joined instead, with the same result.

    Null urls and urls without ``://`` have an empty host and path, no rule and the default verdict.
    Repeated rows and repeated rules are read one by one, an empty table gives an empty result,
    without rules every url has the default verdict, urls of any length are read whole, and other
    columns are left out, so their names cannot clash.
    """
    if not isinstance(rules, DataFrame):
        rules = [_normal(r) for r in rules if r.verdict is not None and r.host is not None]
        if len(rules) > max_trie_rules or sum(len(r.text) for r in rules) > max_trie_chars:
            return _joined(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), id_col, url_col, default)
    else:
        rules = _normal_table(rules)
        n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
        if n > max_trie_rules or chars > max_trie_chars:
            return _joined(pages, rules, id_col, url_col, default)
        rules = [Rule(*r) for r in rules.collect()]  # as many as were just counted
    token = uuid.uuid4().hex
    trie = pages.sparkSession.sparkContext.broadcast(pickle.dumps(UrlTrie(rules)))

    def judge(ids, urls):
        known = built(token, lambda: pickle.loads(trie.value))
        for key, url in zip(ids, urls):
            host, path = split_url(url)
            rule = known.find(host, path)
            yield key, url, host, path, rule and rule.text, rule.verdict if rule else default

    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(pages, [id_col, url_col], f"`{id_col}` {kind}, `{url_col}` string, host string, path string, rule string, verdict string", judge)


def _normal(rule: Rule) -> Rule:
    path = rule.path or ""
    return Rule(rule.verdict, rule.host.translate(ASCII_LOWER), path if path[:1] in ("", "/") else "/" + path)


def _normal_table(rules: DataFrame) -> DataFrame:
    path = F.coalesce("path", F.lit(""))
    path = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return rules.where("verdict is not null and host is not null").select("verdict", _lower(F.col("host")).alias("host"), path.alias("path"))


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str) -> DataFrame:
    """Equi-join of each url's (host suffix, path prefix) keys with the rules' keys.

    Only prefixes as long as some rule's path are made; their number is bounded by a url's length.
    """
    url = F.col(url_col)
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url)))
    host = F.coalesce(_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    base = pages.select(F.col(id_col), F.col(url_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).distinct()
    lengths = [r[0] for r in keys.select(F.length("rule_path")).distinct().collect()]
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    urls = base.select("host", "path").distinct()
    probes = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).select("*", F.explode(prefixes).alias("rule_path"))
    text = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(text), F.length("rule_host"), F.col("verdict") == "block")
    best = probes.join(keys, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct(text.alias("rule"), "verdict"), rank).alias("best"))
    return base.join(best, ["host", "path"], "left").select(id_col, url_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
