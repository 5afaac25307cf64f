"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on up
to `?`, `#` or the end. A null url, or one without `://`, has both empty, fits no rule and gets the method's
verdict on no n-grams. Repeated rows are judged alike; an empty table gives an empty result. A score at the
threshold blocks. A very long url is scored whole, each n-gram once.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Words that hosts and paths to block tend to carry.
CUES = """casino poker roulette jackpot betting bet slots bingo lottery gamble wager porn xxx adult sex escort nude cam hookup dating
viagra cialis pills pharma meds steroid dietpill slimming payday loan credit debt forex binary invest bitcoin doubler airdrop giveaway
prize winner free cheap discount replica rolex crack keygen warez torrent serial hack cheat spam click popup adserver ads tracker
banner followers likes traffic backlink seo farm clone phish verify unlock win"""
#: Well-known sites, by the label of their host.
SITES = """wikipedia github gitlab stackoverflow arxiv python apache mozilla debian ubuntu kernel gnu w3 ietf rust-lang golang postgresql
sqlite numpy pandas bbc nytimes guardian reuters lemonde spiegel elpais economist nature science sciencedirect springer ieee acm
pubmed nasa noaa who un europa loc archive gutenberg imdb goodreads britannica merriam-webster duolingo khanacademy coursera mit
stanford harvard oxford cambridge medium wordpress blogger reddit tumblr flickr vimeo soundcloud bandcamp ebay etsy ikea lego"""
#: Ordinary words of hosts and paths.
PLAIN = """news weather recipes garden library museum history school travel music film sport health hospital council university
physics chemistry biology math forum blog docs help support archive journal review photo art design books poetry theatre cinema
bakery coffee kitchen farmers market cycling running hiking football tennis chess parish village river forest ocean mountain bird
insect geology astronomy climate energy solar railway bus airport ferry post bank insurance lawyer dentist clinic vet pet horse
linux data code open source open-data project team studio workshop lab notes diary family wedding baby toy craft knitting wood"""
#: What both classes end in.
ENDS = "com net org info io co.uk de fr es it edu gov biz site online example.com example.org"


def labelled_urls(seed: int = 41, rows: int = 3000) -> list[tuple[str, int]]:
    """About `rows` urls without scheme, by rule from the words above, 1 for those to block: made up but for the sites' names.

    Both classes use the same ends, prefixes and paths, and hosts of one or two words or of random syllables, so only the
    cues tell them apart. A quarter of those to block carry the cue in the path."""
    rng, out = random.Random(seed), []
    cues, sites, plain, ends = CUES.split(), SITES.split(), PLAIN.split(), ENDS.split()

    def syllables() -> str:
        return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice(("a", "e", "i", "o", "u", "en", "th", "er", "ing")) for _ in range(rng.randint(2, 4)))

    def any_word() -> str:
        return rng.choice(plain) if rng.random() < 0.6 else syllables()

    def url(host: str, path: str) -> str:
        return f"{rng.choice(('', '', 'www.', 'm.', 'blog.'))}{host}.{rng.choice(ends)}/{path}"

    def path() -> str:
        return "/".join([*rng.choices(("en", "de", "fr", "es", "2023", "p", any_word()), k=rng.randint(0, 2)), str(rng.randint(1, 999)) + rng.choice(("", ".html"))])

    for i in range(rows // 3):
        cue, other = cues[i % len(cues)], rng.choice((rng.choice(cues), any_word(), str(rng.randint(1, 99)), rng.choice("xyz")))
        host = rng.choice(("{0}{2}{1}", "{1}{2}{0}", "{0}{1}", "{0}")).format(cue, other, rng.choice("-- ").strip())
        out.append((url(host, path()) if rng.random() < 0.75 else url(any_word(), f"{cue}-{other}/{path()}"), 1))
        host = rng.choice((rng.choice(sites), any_word(), any_word() + rng.choice(("-", "")) + any_word()))
        out.append((url(host, path()), 0))
        out.append((url(rng.choice((syllables(), rng.choice(sites), any_word() + "-" + syllables())), path()), 0))
    return out


#: What an n-gram that occurs counts.
SCALE = 0.2
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules are tried in one expression; longer lists are refused.
MOST_RULES = 1000


def parts(url) -> tuple[F.Column, F.Column]:
    """(host, path) of a url column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host, path, rules: Iterable[tuple[str, str]] = RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits; of equal lengths the first."""
    rules = sorted(rules, key=lambda r: -len(r[1]))
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for what, text in reversed(rules):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str, width: int, sizes=(3, 4, 5)) -> np.ndarray:
    """Hashed n-grams of host and path, each set once; host and path have grams of their own."""
    found = set()
    for kind, text in ((b"h", host), (b"p", path)):
        if text:
            raw = b"^" + text.encode("utf-8", "surrogatepass") + b"$"
            found.update(zlib.crc32(kind + raw[i : i + n]) % width for n in sizes for i in range(len(raw) - n + 1))
    return np.fromiter(found, np.int64, len(found))


class UrlModel:
    """Logistic regression, fitted by gradient descent on a small labelled table of urls without scheme (3000 rows)."""

    def __init__(self, labelled: Iterable[tuple[str, int]] | None = None, width: int = 1 << 17, steps: int = 200, rate: float = 0.15, decay: float = 1e-6):
        rows = list(labelled_urls() if labelled is None else labelled)
        found = [grams(host, slash + path, width) for host, slash, path in (u.partition("/") for u, _ in rows)]
        y = np.array([y for _, y in rows], float)
        at = np.concatenate([*found, np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(rows)), [len(g) for g in found])
        w, m, v = np.zeros((3, width + 1))  # the bias stands last
        for k in range(1, (steps if len(rows) else 0) + 1):
            total = np.bincount(row, weights=w[at], minlength=len(rows)) * SCALE + w[-1]
            off = (1 / (1 + np.exp(-total)) - y) / len(y)
            g = decay * w
            g[:-1] += np.bincount(at, weights=off[row], minlength=width) * SCALE
            g[-1] += off.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g  # Adam
            w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        self.width, self.weights, self.bias = width, w[:-1].astype(np.float32), float(w[-1])

    def score(self, host: str, path: str) -> float:
        """Probability of block; 0 for an empty host."""
        total = float(self.weights[grams(host, path, self.width)].sum()) * SCALE + self.bias
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, total)))) if host else 0.0


def judge(pages: DataFrame, rules=RULES, model: UrlModel | None = None, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, url_score (null where a rule decides) and verdict."""
    model = model or UrlModel()

    @pandas_udf("double")
    def scored(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else model.score(h, p) for h, p in zip(host, path, strict=True)], dtype="float64")

    host, path = parts(F.col(url))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    # a host that a rule decides goes to Python as null
    open_ = F.when(rule.isNull(), F.col("host"))
    rows = rows.withColumns({"rule": rule, "verdict": said, "url_score": scored(open_, F.col("path"))})
    found = F.when(F.col("url_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", F.coalesce("verdict", found))
