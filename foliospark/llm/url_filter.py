"""URL filter: host and path rules, then a weighted vocabulary found by one Aho-Corasick automaton.

The automaton runs over the url, A-Z lower-cased, and counts strict and soft terms; a hit counts only where neither
neighbour is one of a-z and 0-9. A url is blocked on one strict hit or on `min_soft` distinct soft terms. Each term has a
weight of its own, and a url weighs what its distinct terms do together; weights rank urls for review and
do not change the verdict. A rule that fits decides before the vocabulary does.

Rows are judged one by one, so no key or hot host matters. Null urls and urls without "://" have an empty host
and path, fit no rule, and are judged by the vocabulary alone (null: no hit, allowed). Repeated rows give
repeated results; other columns of the input are carried along unless they clash with a result column, which
then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _weights(text: str) -> dict[str, int]:
    """'100 a b 80 c' -> {a: 100, b: 100, c: 80}"""
    out: dict[str, int] = {}
    weight = 0
    for word in text.split():
        if word.isdigit():
            weight = int(word)
        else:
            out[word] = weight
    return out


#: Terms and their weights in hundredths; further ones come as a file (read_vocabulary).
STRICT = _weights("""
100 porn porno xxx hentai camgirl camgirls escort escorts hardcore milf nudes sexcam sexshop
100 malware phishing keylogger ransomware botnet carding fullz cvv
90 casino casinos viagra cialis levitra tramadol xanax payday warez keygen crackz nulled
80 spam spammer torrent torrents sportsbook slots roulette blackjack bookmaker replica linkfarm
""")
SOFT = _weights("""
60 adult dating poker betting gambling jackpot lottery pharmacy pills steroids webcam
50 bet bets bonus loan loans forex bitcoin crypto wager lotto singles hookup
40 cheap discount coupon coupons deal deals offer offers promo rebate voucher
30 farm free win winner click clicks download downloads crack serial mirror proxy
20 ref affiliate referral popup redirect track tracker utm sponsor sponsored
""")
MIN_SOFT = 2

_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_distinct int, weight double"


def split_url(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: then up to ? # or end."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[stop:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:stop].translate(_LOWER), tail[:end]


def read_vocabulary(path: str) -> tuple[dict[str, int], dict[str, int]]:
    """Strict and soft terms of a text file with lines 'term kind hundredths', kept on the driver; a list of terms is small."""
    found: tuple[dict[str, int], dict[str, int]] = ({}, {})
    with open(path, encoding="utf-8") as lines:
        for term, kind, weight in (line.split() for line in lines if line.strip()):
            found[kind != "strict"][term] = int(weight)
    return found


def automaton(strict: Iterable[str], soft: Iterable[str]) -> ahocorasick.Automaton:
    """Terms without a weight of their own weigh 100 (strict) or 50 (soft)."""
    found = ahocorasick.Automaton()
    for kind, terms, usual in (("soft", soft, 50), ("strict", strict, 100)):
        for t in terms:
            found.add_word(t, (kind, t, terms[t] if isinstance(terms, Mapping) else usual))
    if len(found):
        found.make_automaton()
    return found


def count_terms(found: ahocorasick.Automaton, url: str | None) -> tuple[int, int, int, float]:
    """Strict hits, soft hits, distinct soft terms, weight of all distinct terms."""
    hits = {"strict": 0, "soft": 0}
    terms: dict[str, tuple[str, int]] = {}
    if url and len(found):
        low = url.translate(_LOWER)
        for last, (kind, term, weight) in found.iter(low):
            first = last - len(term) + 1
            if not ((first and low[first - 1] in _LETTERS) or (last + 1 < len(low) and low[last + 1] in _LETTERS)):
                hits[kind] += 1
                terms[term] = (kind, weight)
    return hits["strict"], hits["soft"], sum(k == "soft" for k, _ in terms.values()), sum(w for _, w in terms.values()) / 100


def rule_table(rules: Sequence[tuple[str, str, str]]) -> dict[str, list[tuple[int, str, str]]]:
    """By host: (length of host and path, path, verdict), longest first."""
    by_host: dict[str, list[tuple[int, str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((len(host) + len(path), path, verdict))
    return {h: sorted(v, reverse=True) for h, v in by_host.items()}


def match_rule(by_host: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule whose host is this host or a parent domain of it and whose path starts the path."""
    best: tuple[int, str, str] | None = None
    suffix = host
    while suffix:
        for size, start, verdict in by_host.get(suffix, ()):
            if path.startswith(start) and (best is None or size > best[0]):
                best = (size, suffix + start, verdict)
        suffix = suffix.partition(".")[2]
    return (best[1], best[2]) if best else (None, None)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    min_soft: int = MIN_SOFT,
    url_col: str = "url",
) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), hit counts and weight.

    rules: (allow or block, host, path). strict, soft: terms, or terms and their weights in hundredths.
    """
    by_host, cache = rule_table(rules), {}

    @F.pandas_udf(RESULT)
    def judge(urls: pd.Series) -> pd.DataFrame:
        found = cache.setdefault("automaton", automaton(strict, soft))
        rows = []
        for url in urls:
            host, path = split_url(url)
            rule, verdict = match_rule(by_host, host, path)
            n_strict, n_soft, distinct, weight = count_terms(found, url)
            own = "block" if n_strict or distinct >= min_soft else "allow"
            rows.append((host, path, rule, verdict or own, n_strict, n_soft, distinct, weight))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    names = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in pages.columns if c not in names]
    judged = pages.select(*kept, judge(F.col(url_col)).alias("judged_"))
    return judged.select(*kept, *[F.col(f"judged_.{n}").alias(n) for n in names])
