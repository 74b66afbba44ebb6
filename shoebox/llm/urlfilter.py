"""URL allow and block rules with longest-match precedence.

Rules are kept in a trie over reversed host labels; each host node holds a trie over path
segments.  A URL walks down once, whatever the number of rules.  The trie is broadcast while its
measured size is below a bound; larger rule sets are joined on host suffixes instead.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Pickled size up to which the trie is broadcast.
BROADCAST_BYTES = 64 << 20
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``verdict`` ('allow' or 'block') for ``host`` with its subdomains, paths starting ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``block com/en/``; a rule without path fits every path."""
    found = []
    for line in lines:
        verdict, _, rest = line.strip().partition(" ")
        if verdict not in ("allow", "block") or not rest:
            raise ValueError(f"not a rule: {line!r}")
        host, slash, path = rest.strip().partition("/")
        found.append(Rule(verdict, host.translate(_LOWER), slash + path))
    return found


@dataclass
class _Paths:
    below: dict[str, _Paths] = field(default_factory=dict)
    ends: dict[str, Rule] = field(default_factory=dict)  # beginnings of the next segment
    sizes: set[int] = field(default_factory=set)


@dataclass
class _Hosts:
    below: dict[str, _Hosts] = field(default_factory=dict)
    whole: Rule | None = None
    paths: _Paths = field(default_factory=_Paths)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or a URL without ``://``."""
    rest = (url or "").partition("://")[2]
    host = _HOST.match(rest)[0]
    return host.translate(_LOWER), _PATH.match(rest, len(host))[0]


class UrlTrie:
    """Longest match: the longest fitting host decides first, then the longest path under it.

    Of two rules for the same host and path the blocking one holds.
    """

    def __init__(self, rules: list[Rule]):
        self.root = _Hosts()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Hosts())
            if not rule.path:
                node.whole = rule if node.whole is None or rule.verdict == "block" else node.whole
                continue
            *full, start = rule.path.split("/")[1:]
            at = node.paths
            for segment in full:
                at = at.below.setdefault(segment, _Paths())
            if start not in at.ends or rule.verdict == "block":
                at.ends[start] = rule
            at.sizes.add(len(start))

    def find(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        segments = path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            best = self._path(node.paths, segments) or node.whole or best
        return best

    @staticmethod
    def _path(at: _Paths, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            for size in sorted(at.sizes, reverse=True):
                if len(segment) >= size and segment[:size] in at.ends:
                    best = at.ends[segment[:size]]
                    break
            at = at.below.get(segment)
            if at is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per input row.

    ``rule`` is the text of the rule that decided, null if none fits; then ``verdict`` is
    ``default``.  Null URLs and URLs without ``://`` have empty host and path.  Very long URLs are
    judged whole.  Repeated rows give repeated rows.
    """
    trie = UrlTrie(rules)
    if len(pickle.dumps(trie)) > broadcast_bytes:
        return filter_urls_by_join(pages, rules, id_col, url_col, default)
    shared = pages.sparkSession.sparkContext.broadcast(trie)
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType)] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def judge(batches):
        find = shared.value.find
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [find(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array([r.text if r else None for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string()),
            ], names=schema.names)

    return pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url")).mapInArrow(judge, schema)


def filter_urls_by_join(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same result for rule sets too large to broadcast: an equi-join on host suffixes.

    Distinct (host, path) pairs are judged, so a host that holds a third of all pages is joined
    once per distinct path; they are then joined back.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, verdict string")
    url = F.coalesce(F.col("url"), F.lit(""))
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.col("rest"), r"^[^/?#]*", 0)
    parts = source.select("page_id", rest.alias("rest")).select(
        "page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        parts.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
        .join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule_host"), F.length("rule_path"), (F.col("verdict") == "block"), "rule", "verdict")).alias("b"))
        .select("host", "path", "b.rule", "b.verdict")
    )
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
