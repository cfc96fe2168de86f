"""URL filters: host and path rules, then logistic regression on hashed n-grams.

Rules decide where one fits (its host or a subdomain, the url's path starting
with the rule's; the longest rule wins). All other urls are judged by a
logistic regression on hashed character n-grams of host and path, trained
from a small labelled table of urls. The table is independent of the rules:
:func:`labelled_urls` makes it from names of ordinary and of unwanted sites,
with top-level domains, languages and paths dealt out alike to both, so that
these tell nothing.

Nulls and edge cases: a null url, or one without ``://``, has an empty host
and path and no rule, and the model judges the empty strings; a null page_id
is kept; repeated rows give repeated results, an empty table an empty result;
other columns are ignored. Without labelled urls the model allows all.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Names of the sites in the labelled table, and urls for each.
ORDINARY = """
    library museum university college school academy science journal gazette tribune herald chronicle weather
    garden recipes kitchen bakery travel railway airport harbour theatre orchestra gallery archive history
    football cycling hiking climbing chess knitting carpentry bicycle hospital clinic pharmacy-council dentist
    parliament council ministry city-hall police fire-brigade statistics census python-docs linux-wiki compiler
    database algorithms mathematics physics chemistry biology astronomy geology economics philosophy literature
    poetry novels dictionary encyclopedia translation grammar radio television podcast newsletter photography
    painting architecture engineering farming fishing forestry beekeeping wildlife ocean mountain village
    thornton nations blessing shining station standing
""".split()
UNWANTED = """
    casino online-casino casino-bonus royal-casinos poker poker-room slots free-slots jackpot roulette betting
    free-bet bets-now sportsbets bookmaker win-big winbig winners-win lottery-win pills cheap-pill diet-pills
    viagra cialis cheap-meds cheapmeds no-prescription payday-loan fast-loans easy-loan free-money getrich
    get-rich-quick crypto-doubler porn free-porn xxx xxx-videos sex-cams adult-cams hot-girls escorts nude-pics
    warez cracks keygen serial-crack torrent-free free-download-crack replica-watches fake-watches cheap-replica
    click-here popup-ads ads ad-server track-ads adult spam spam-links link-farm malware phishing-login free-iphone free-prize prize-win miracle-cure
""".split()
URLS_EACH = 5
DIMENSIONS = 1 << 14
#: Share of wanted urls assumed in training.
PRIOR = 0.6
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = SPLIT.match(rest)
    return m[1].translate(UPPER), m[2]


class Rules:
    def __init__(self, rules: Iterable[tuple[str, str]] = RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed 3- to 5-grams of ^host$ and ^path$."""
    out = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in (3, 4, 5):
            for i in range(len(s) - n + 1):
                out.add(zlib.crc32((mark + s[i : i + n]).encode("utf-8", "replace")) % DIMENSIONS)
    return np.fromiter(sorted(out), np.int64, len(out))


class UrlModel:
    """Logistic regression; p() is the probability that a url is to be allowed."""

    def __init__(self, labelled: Iterable[tuple[str, str]], rounds: int = 200, rate: float = 4.0, decay: float = 1e-4):
        rows = sorted(labelled)
        self.weights, self.bias = np.zeros(DIMENSIONS), 0.0
        y = np.array([verdict == "allow" for _, verdict in rows], float)
        if not rows or y.min() == y.max():
            self.bias = 4.0 if not rows or y[0] else -4.0
            return
        cols = [features(*parts(u)) for u, _ in rows]
        row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
        col = np.concatenate(cols)
        value = np.repeat([1 / np.sqrt(max(len(c), 1)) for c in cols], [len(c) for c in cols])
        # most urls are wanted: what tells nothing is allowed
        each = np.where(y == 1, PRIOR / y.sum(), (1 - PRIOR) / (1 - y).sum())
        for _ in range(rounds):
            z = np.bincount(row, self.weights[col] * value, len(rows)) + self.bias
            error = (y - 1 / (1 + np.exp(-z))) * each
            self.weights += rate * (np.bincount(col, error[row] * value, DIMENSIONS) - decay * self.weights)
            self.bias += rate * error.sum()

    def p(self, host: str, path: str) -> float:
        f = features(host, path)
        return float(1 / (1 + np.exp(-(self.weights[f].sum() / np.sqrt(max(len(f), 1)) + self.bias))))


def labelled_urls(seed: int = 17) -> list[tuple[str, str]]:
    """The small labelled table: (url, allow or block), URLS_EACH for each name."""
    rng = random.Random(seed)
    out = []
    for verdict, names in (("allow", ORDINARY), ("block", UNWANTED)):
        for name in names:
            for _ in range(URLS_EACH):
                host = rng.choice(("", "www.", "m.", "blog.", "news.", "shop.")) + name + rng.choice(("", ".example", "-site", "24")) + rng.choice((".com", ".org", ".net", ".info", ".co.uk"))
                page = rng.choice(("", "index", "about", "page", "item")) + str(rng.randint(1, 9999))
                path = rng.choice(("/", "/en/", "/de/", "/fr/", "/es/")) + page + rng.choice(("", "/", ".html"))
                out.append((f"{rng.choice(('http', 'https'))}://{host}{path}", verdict))
    return out


def judge(pages: DataFrame, rules: Rules, model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict, p_allow."""
    bounded(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((rules, model))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, model = shared.value
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                p = model.p(host, path)
                rule, verdict = rules.match(host, path) or (None, "allow" if p >= 0.5 else "block")
                rows.append((host, path, rule, verdict, p))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "p_allow"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, p_allow double")
