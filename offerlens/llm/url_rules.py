"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal
tokens any matching url must hold as whole tokens. Token frequencies are
counted over all urls; a rule is filed under its rarest token, and a url only
runs the expressions of the rules that its own tokens fetch (rules without a
token are run on every url). The rule list is part of the program, so the
index that each task receives does not grow with the urls; urls are never
shuffled.

Cases: a null url or one without ``://`` has empty host and path, no rule and
the default verdict; repeated rows are judged alike; other columns pass
through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm.exact_dedup import lower_a_to_z

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """``host`` and its subdomains, where the url's path starts with ``path``."""
    tokens = TOKEN.findall(host)
    # a path's last token may go on in the url, unless something ends it
    tokens += [m.group() for m in TOKEN.finditer(path) if m.end() < len(path) and not re.search("[A-Z]", path)]
    return Rule(host + path, verdict, rf"(?:[^/?#]*\.)?{re.escape(host + path)}", tuple(dict.fromkeys(tokens)), True)


#: FIXED VALUES: the listed rules; the longest that fits decides.
LISTED = (host_rule("allow", "org", "/"), host_rule("block", "example.org", "/es/"),
          host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"),
          host_rule("block", "com", "/de/"))

#: The method's own patterns, for urls that no listed rule fits: advertising, tracking and malware hosts or paths.
PATTERNS = tuple(Rule(t, "block", p, tuple(TOKEN.findall(t))) for t, p in (
    ("ads-track", r"(?:[^/?#]*[.])?ads-track[.]"), ("adserver", r"(?:[^/?#]*[.])?adserver[.]"),
    ("doubleclick", r"(?:[^/?#]*[.])?doubleclick[.]"), ("popunder", r"[^?#]*/popunder(?:[/.]|$)"),
    ("clicktracker", r"(?:[^/?#]*[.])?clicktracker[.]"), ("phish", r"(?:[^/?#]*[.])?phish[.-]"),
    ("banner-ads", r"[^?#]*/banner-ads/"), ("casino-bonus", r"[^?#]*/casino-bonus(?:[/.]|$)"),
))
DEFAULT = "allow"


def split_url(col):
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    rest = F.when(F.instr(col, "://") > 0, F.substr(col, F.instr(col, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return lower_a_to_z(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many urls hold each token of the rules (at most one row per rule token reaches the driver)."""
    rows = (urls.select(F.explode(F.array_distinct(F.split(F.lower(F.concat_ws("", "host", "path")), "[^a-z0-9]+"))).alias("t"))
            .where(F.col("t").isin(vocabulary)).groupBy("t").count().collect())
    return {r["t"]: r["count"] for r in rows}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules filed under their rarest token, and the rules that have none."""
    filed: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if r.tokens:
            filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(i)
        else:
            always.append(i)
    return filed, always


def judge(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, default: str = DEFAULT) -> DataFrame:
    """``pages`` (any columns, ``url`` among them) with host, path, rule, verdict and n_candidates."""
    host, path = split_url(F.col("url"))
    urls = pages.drop("host", "path", "rule", "verdict", "n_candidates").withColumns({"host": host, "path": path})
    counts = token_counts(urls, sorted({t for r in rules for t in r.tokens}))
    filed, always = rule_index(rules, counts)
    schema = T.StructType([*urls.schema.fields, T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType()), T.StructField("n_candidates", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            names, verdicts, tried = [], [], []
            hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            for h, p in zip(hosts, paths):
                place = h + p
                fetched = [i for t in dict.fromkeys(TOKEN.findall(place.lower())) for i in filed.get(t, ())] + always
                hits = [rules[i] for i in fetched if compiled[i].match(place)] if h else []
                listed = [r for r in hits if r.listed]
                best = max(listed, key=lambda r: len(r.name), default=None)
                names.append(best.name if best else None)
                verdicts.append(best.verdict if best else hits[0].verdict if hits else default)
                tried.append(len(fetched))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(tried, pa.int64())],
                names=[*batch.schema.names, "rule", "verdict", "n_candidates"])

    return urls.mapInArrow(run, schema)
