"""URL rules behind an index of their rarest literal tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns that one index may hold; it is sent to every executor.
MAX_RULE_BYTES = 64 << 20
_TOKEN = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST = re.compile("://([^/?#]*)([^?#]*)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """A rule on a host with all its subdomains and a path's start, or on a pattern anywhere in host and path.

    In a pattern `*` is any text and `^` a separator: a character other than an ASCII letter or digit, or an end.
    """

    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str:
        return self.pattern or self.host + self.path

    @property
    def regex(self) -> str:
        """Over lower-case host and path, for patterns; over host, a NUL and the path as it is, for hosts."""
        if not self.pattern:
            return rf"(?s)\A(?:[^\0]*\.)?{re.escape(self.host)}\0{re.escape(self.path)}"
        parts = {"*": ".*", "^": "(?:[^a-z0-9]|$|^)"}
        return "(?s)" + "".join(parts.get(c) or re.escape(c) for c in self.pattern.translate(_LOWER))

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every match holds whole: those with a separator or the host's end on both sides."""
        if not self.pattern:
            return re.findall(r"(?<![a-z0-9])[a-z0-9]+(?![a-z0-9])", self.host) + re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", self.path.translate(_LOWER))
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", self.pattern.translate(_LOWER))


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for null and for a url without `://`."""
    found = _HOST.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def _tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(host)) | set(_TOKEN.findall(path.translate(_LOWER)))


class RuleIndex:
    """Rules by one token each, the one that fewest urls have; rules without a token are candidates for every url."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        self.compiled: dict[str, re.Pattern] = {}
        for rule in rules:
            if tokens := rule.tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
            else:
                self.always.append(rule)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str]:
        """The longest host rule that fits, the longest pattern that fits, and the verdict."""
        best: tuple[tuple, Rule] | None = None
        other: tuple[tuple, Rule] | None = None
        candidates = [r for t in _tokens(host, path) for r in self.by_token.get(t, ())] + self.always
        exact, loose = f"{host}\0{path}", f"{host}{path}".translate(_LOWER)
        for rule in candidates:
            regex = self.compiled.get(rule.regex) or self.compiled.setdefault(rule.regex, re.compile(rule.regex))
            if rule.pattern:
                if regex.search(loose):
                    other = max(other or ((-1,), rule), ((len(rule.name), rule.name), rule), key=lambda x: x[0])
            elif regex.search(exact):
                best = max(best or ((-1,), rule), ((len(rule.name), rule.name), rule), key=lambda x: x[0])
        chosen = best or other
        return best and best[1].name, other and other[1].name, chosen[1].action if chosen else "allow"


def token_counts(pages: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """In how many urls each of the wanted tokens is; at most one row for each of them comes to the driver."""
    rest = F.regexp_extract("url", "(?s)://(.*)", 1)
    token = F.explode(F.array_distinct(F.split(F.lower(rest), "[^a-z0-9]+"))).alias("token")
    return {r.token: r.n for r in pages.select(token).where(F.col("token").isin(list(wanted))).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()} if wanted else {}


def filter_urls(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row for each page: page_id, host, path, rule, pattern and verdict.

    rule is the longest host rule that fits, pattern the longest pattern; the host rule's action is the verdict, else
    the pattern's, else allow. A null url, an empty one and one without `://` have an empty host and path, which host
    rules do not fit. Repeated rows are judged alike; other columns are not read; an empty table gives no rows.

    The rules are a parameter of bounded size (MAX_RULE_BYTES, checked), so their index goes to every executor and the
    urls are judged where they are read, without a shuffle.
    """
    if sum(len(r.name) + len(r.action) for r in rules) > MAX_RULE_BYTES:
        raise ValueError(f"the rules hold more than {MAX_RULE_BYTES} bytes; give them in parts")
    counts = token_counts(pages, sorted({t for r in rules for t in r.tokens}))
    index = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules, counts))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [host_and_path(u) for u in batch["url"].to_pylist()]
            columns = zip(*[(h, p, *index.value.judge(h, p)) for h, p in places], strict=True) if places else [[]] * 5
            text = [pa.array(c, pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch["page_id"], *text], ["page_id", "host", "path", "rule", "pattern", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url").mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, pattern string, verdict string")
