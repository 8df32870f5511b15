"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host`` + ``path`` with the literal tokens that any matching
url must hold. Each rule is filed under the one of its tokens that is rarest among the tokens of all
urls, so a url fetches, token by token, only the few rules that could fit and runs only those.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there
up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path; no rule
fits it and it is allowed. Of the host/path rules that fit, the longest decides; if none fits, a
blocking pattern rule decides; else the url is allowed. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trainset.llm.common import as_text

ALLOW, BLOCK = "allow", "block"
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_TOKEN = re.compile(r"[a-z0-9]+|[^\x00-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
MAX_RULE_BYTES = 64 << 20  # rules travel to every worker; more than this raises


@dataclass(frozen=True)
class Rule:
    """``name`` is reported if set; ``tokens`` are in every url that ``pattern`` finds."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None
    length: int = 0


def tokens_of(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall((host + path).translate(_LOWER)))


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule like ``example.com/de/``: the host and all its subdomains, paths that start so."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = path[: max(path.rfind(c) for c in "/.-_") + 1] if path else ""  # the last token may go on
    return Rule(verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(sorted(tokens_of(host, whole))), rule, len(rule))


def word_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(verdict, pattern, tokens)


#: Contract rules, as given.
HOST_RULES = (
    host_rule(BLOCK, "net/"),
    host_rule(ALLOW, "example.net/en/"),
    host_rule(BLOCK, "example.com/de/"),
    host_rule(ALLOW, "org/fr/"),
)


def label_rule(*words: str) -> Rule:
    """Blocks hosts with a label that holds these words, parted by hyphens."""
    return Rule(BLOCK, rf"\A([^/]*[.-])?{'-'.join(words)}[.-]", words)


#: Hosts of advertisers, betting, pills, spam and adult pages; sign-in and basket pages, downloads.
PATTERN_RULES = (
    *(label_rule(*x) for x in (("ads", "track"), ("adserver",), ("tracker",), ("casino",), ("bets",), ("pills",), ("spam",), ("adult",), ("porn",))),
    *(word_rule(BLOCK, rf"/{x}(/|\Z)", x) for x in ("login", "signup", "cart", "checkout")),
    *(word_rule(BLOCK, rf"\.{x}\Z", x) for x in ("zip", "exe", "pdf")),
)


def split_url(url: str) -> tuple[str, str]:
    m = _URL.search(url)
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def token_counts(urls: DataFrame, url: str, wanted: set[str]) -> dict[str, int]:
    """How many urls hold each wanted token; partitions count, the sums are as many as the tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in as_text(batch.column(0)):
                seen.update(tokens_of(*split_url(text)) & wanted)
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    counted = urls.select(F.col(url)).mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; a rule without tokens is filed under "" and tried on every url."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(rarest, []).append(rule)
    return index


def judge(host: str, path: str, index: dict[str, list[tuple[re.Pattern, Rule]]]) -> tuple[str | None, str]:
    if not host and not path:
        return None, ALLOW
    place, best = host + path, None
    for token in ("", *tokens_of(host, path)):
        for pattern, rule in index.get(token, ()):
            order = (rule.name is not None, rule.length, rule.verdict == BLOCK, rule.pattern)
            if (best is None or order > best[0]) and pattern.search(place):
                best = (order, rule)
    return (best[1].name, best[1].verdict) if best else (None, ALLOW)


def filter_urls(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url",
    host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES,
) -> DataFrame:
    """One row per page: page_id, host, path, the host/path rule that decided (else null) and the verdict."""
    rules = (*host_rules, *pattern_rules)
    if sum(len(r.pattern) + sum(map(len, r.tokens)) + 100 for r in rules) > MAX_RULE_BYTES:
        raise ValueError("the rules are too large to send to every worker; split them and filter in turns")
    index = rule_index(rules, token_counts(pages, url, {t for r in rules for t in r.tokens}))
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {t: [(re.compile(r.pattern, re.S), r) for r in rs] for t, rs in shared.value.items()}
        for batch in batches:
            places = [split_url(u) for u in as_text(batch.column(1))]
            verdicts = [judge(h, p, compiled) for h, p in places]
            columns = [*zip(*places), *zip(*verdicts)] or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"]
            )

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id), F.col(url)).mapInArrow(
        apply, f"page_id {kind}, host string, path string, rule string, verdict string"
    )


def oracle(table: str = "pages") -> str:
    """The same verdicts in SQL, with every rule tried on every url."""
    cases, names = [], {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}
    for rule in sorted(names, key=len, reverse=True):
        host, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    patterns = " OR ".join(f"regexp_matches(host || path, '{r.pattern.replace(chr(92) + 'Z', chr(92) + 'z')}')" for r in PATTERN_RULES)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in names.items())
    return f"""
    WITH parts AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {table}),
    ruled AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE {verdicts} WHEN {patterns} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
