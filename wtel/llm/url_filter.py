"""URL filter: a weighted vocabulary found by an Aho-Corasick automaton, and host rules before it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Terms of which one is enough to reject.
STRICT = (
    "adult-x", "camgirls", "casino", "escorts", "hentai", "milf", "nsfw", "phishing", "porn", "porno",
    "pornhub", "slots", "viagra", "warez", "xnxx", "xvideos", "xxx",
)
#: Terms of which several different ones are needed.
SOFT = (
    "ads", "adult", "bet", "bets", "bonus", "cheap", "click", "crack", "dating", "deals", "farm", "free",
    "gambling", "girls", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "pharma", "pills",
    "poker", "prize", "promo", "replica", "sex", "spam", "torrent", "track", "win",
)
SOFT_HITS = 2
STRICT_WEIGHT, SOFT_WEIGHT = 2, 1

COLUMNS = "host string, path string, rule string, verdict string, n_strict int, n_soft int"
_LOWER = {c: c + 32 for c in range(65, 91)}
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for a null url or one without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for stop in "?#":
        rest = rest.split(stop, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


@lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(term, (len(term), term, weight))
    found.make_automaton()
    return found


def hits(text: str, terms: tuple[tuple[str, int], ...]) -> dict[str, int]:
    """The different terms in a lower-cased text that no letter or digit touches, with weights."""
    if not terms:
        return {}
    out, last = {}, len(text) - 1
    for end, (size, term, weight) in _automaton(terms).iter(text):
        start = end - size + 1
        if (start == 0 or text[start - 1] not in _INSIDE) and (end == last or text[end + 1] not in _INSIDE):
            out[term] = weight
    return out


def _by_host(rules: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Paths and verdicts of each host, the longest path first."""
    out: dict[str, list[tuple[str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, verdict))
    for found in out.values():
        found.sort(key=lambda x: -len(x[0]))
    return out


def fitting(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits the host or one of its parents, and its verdict."""
    best, at = None, 0
    while host:
        suffix = host[at:]
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start):
                if best is None or len(suffix) + len(start) > len(best[0]):
                    best = suffix + start, verdict
                break
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] = (),
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """Judge every row's ``url``: page_id and ``COLUMNS``.

    A rule (``host/path``, verdict) fits its host and all subdomains if the url's path starts with
    the rule's; the longest decides. Without one, the url after ``://``, A-Z lower-cased, is blocked if it
    holds one strict term or ``soft_hits`` different soft ones, with no letter a-z or digit beside
    them. Rules and terms are parameters and go to every task.

    A null url, or one without ``://``, has an empty host and path, no hits, no rule and is
    allowed. Only page_id and url are read, so other columns cannot clash; repeated rows and null
    ids stay as they are. An empty table gives an empty result.
    """
    weigh = {str(t).lower(): SOFT_WEIGHT for t in soft} | {str(t).lower(): STRICT_WEIGHT for t in strict}
    terms, table = tuple(sorted(weigh.items())), _by_host(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                whole = url.split("://", 1)[1].translate(_LOWER) if url and "://" in url else ""
                found = list(hits(whole, terms).values())
                n_strict, n_soft = found.count(STRICT_WEIGHT), found.count(SOFT_WEIGHT)
                rule, verdict = fitting(host, path, table) or (None, "block" if n_strict or n_soft >= soft_hits else "allow")
                rows.append((host, path, rule, verdict, n_strict, n_soft))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, {COLUMNS}")
