"""Secret scans: fixed patterns, and credential formats learned by grammar inference.

From labelled credentials of a format, a prefix tree with counts is built and statistically compatible states
are merged (the test of Carrasco and Oncina's ALERGIA) into a probabilistic automaton, with how often each length
occurs. Every part of a run of token characters that begins and ends at the run's ends or at a mark is a candidate.
It is scored by the log-likelihood ratio of its best automaton against chains fitted on ordinary tokens.

A null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows give the same spans;
an empty table gives an empty result. The fixed spans stay; a learned span within a fixed one is not reported
again. Very long texts and runs are read whole; a candidate is as long as the longest credential learned at most.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

#: The patterns of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
IS_TOKEN = np.array([b in TOKEN for b in range(256)])
KINDS = ("assign", "access", "hex")
#: Shortest candidate, and the marks at which a candidate may begin or end inside a run of TOKEN characters.
SHORTEST, MARKS = 16, frozenset("+/_.=-")
_D, _U, _L = string.digits, string.ascii_uppercase, string.ascii_lowercase
_A, _W = _D + _U + _L, _D + _U + _L + "_-"
#: Public credential formats, as a name and parts: literals, or (alphabet, least, most).
FORMATS = (
    ("code_host", "ghp_", (_A, 36, 36)),
    ("code_host", "gho_", (_A, 36, 36)),
    ("code_host", "github_pat_", (_A, 22, 22), "_", (_A, 59, 59)),
    ("package_index", "pypi-AgEIcHlwaS5vcmc", (_W, 60, 120)),
    ("chat", "xoxb-", (_D, 10, 13), "-", (_D, 10, 13), "-", (_A, 24, 24)),
    ("chat", "xoxp-", (_D, 10, 13), "-", (_D, 10, 13), "-", (_D, 10, 13), "-", ("0123456789abcdef", 32, 32)),
    ("cloud_key", "AIza", (_W, 35, 35)),
    ("payment", "sk_live_", (_A, 24, 24)),
    ("payment", "rk_live_", (_A, 24, 24)),
    ("mail", "SG.", (_W, 22, 22), ".", (_W, 43, 43)),
    ("signed", "eyJhbGciOi", (_A, 10, 40), ".eyJ", (_W, 40, 120), ".", (_W, 43, 86)),
    ("random40", (_A + "+/", 40, 40)),
    ("random32", (_A, 32, 32)),
    ("upper_hex", (_D + "ABCDEF", 40, 40)),
)
#: Parts of ordinary tokens.
ROOTS = "data user name file path count index value table column request response server client module system config build version test report summary image style market research language history university"


def _drawn(rng: random.Random, parts: tuple) -> str:
    return "".join(x if isinstance(x, str) else "".join(rng.choices(x[0], k=rng.randint(x[1], x[2]))) for x in parts)


def labelled(per_format: int = 120, seed: int = 23) -> dict[str, list[str]]:
    """Seeded credentials of each public format, by name."""
    rng, out = random.Random(seed), defaultdict(list)
    for name, *parts in FORMATS:
        out[name] += [_drawn(rng, parts) for _ in range(per_format)]
    return dict(out)


def ordinary(per_kind: int = 300, seed: int = 29) -> dict[str, list[str]]:
    """Seeded tokens that are no credentials, by kind: words, identifiers, paths, hosts, numbers, dates and identifiers of records."""
    rng, roots, out = random.Random(seed), ROOTS.split(), defaultdict(list)
    syllable = lambda: rng.choice("bcdfghklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "en", "th", "ing", "er"])
    word = lambda: rng.choice(roots) if rng.random() < 0.5 else "".join(syllable() for _ in range(rng.randint(2, 7)))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    for _ in range(per_kind):
        w = [word() for _ in range(rng.randint(3, 7))]
        out["lower"] += ["".join(w), rng.choice("_-.").join(w), "_".join(w) + str(rng.randint(1, 999))]
        out["upper"] += ["".join(w).upper(), "_".join(w).upper()]
        out["camel"] += ["".join(x.capitalize() for x in w), w[0] + "".join(x.capitalize() for x in w[1:]) + rng.choice(("", str(rng.randint(1, 99))))]
        out["path"] += ["/".join(["", *w]) + rng.choice(("", ".html", ".py", str(rng.randint(1, 9)))), ".".join([*w[:3], rng.choice(("com", "org", "net"))]) + f"/{w[-1]}/{rng.randint(1, 99999)}"]
        out["number"] += [str(rng.randrange(10**15, 10**19)), f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}", ".".join(str(rng.randint(0, 999)) for _ in range(5))]
        out["uuid"] += ["-".join(hexes(n) for n in (8, 4, 4, 4, 12))]
        out["UUID"] += ["-".join(hexes(n) for n in (8, 4, 4, 4, 12)).upper()]
    return dict(out)


#: Classes of characters that are alike, and the log of their sizes; other characters stand for themselves.
CLASS_OF = {c: k for k, chars in (("9", _D), ("f", _L[:6]), ("z", _L[6:]), ("F", _U[:6]), ("Z", _U[6:])) for c in chars}
LOG_SIZE = {"9": math.log(10), "f": math.log(6), "z": math.log(20), "F": math.log(6), "Z": math.log(20)}


def classes(token: str) -> list[str]:
    return [CLASS_OF.get(c, c) for c in token]


def common_starts(words: list[str], least: float = 0.2) -> frozenset[str]:
    """Beginnings that the words share letter by letter: each goes on from one that holds, in `least` of its words."""
    found, level = set(), {"": len(words)}
    while level:
        times: dict[str, int] = defaultdict(int)
        for w in words:
            for p in level:
                if len(w) > len(p) and w.startswith(p):
                    times[w[: len(p) + 1]] += 1
        level = {p: n for p, n in times.items() if n >= max(8, least * level[p[:-1]])}
        found |= set(level)
    return frozenset(found)


class Automaton:
    """A probabilistic automaton from the merged prefix tree of labelled strings, and how long these are.

    Its symbols are the characters of the beginnings that the strings share, then classes."""

    def __init__(self, strings: list[str], alpha: float = 0.01, deepest: int = 40):
        self.starts = common_starts(strings)
        words = [self.symbols(w) for w in strings]
        self.next: list[dict[str, int]] = [{}]
        self.times: list[dict[str, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        for word in words:
            at = 0
            for c in word:
                self.times[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.times.append(defaultdict(int))
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.deepest = deepest
        self._merge()
        self._logs()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.times[q].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int, depth: int = 0) -> bool:
        n, m = self._total(p), self._total(q)
        if self._differ(self.ends[p], n, self.ends[q], m):
            return False
        for c in {*self.times[p], *self.times[q]}:
            if self._differ(self.times[p].get(c, 0), n, self.times[q].get(c, 0), m):
                return False
            if depth < self.deepest and c in self.next[p] and c in self.next[q] and self.next[p][c] != self.next[q][c]:
                if not self._compatible(self.next[p][c], self.next[q][c], depth + 1):
                    return False
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        self.ends[p] += self.ends[q]
        for c, n in self.times[q].items():
            self.times[p][c] += n
            below = self.next[q][c]
            if c in self.next[p]:
                if self.next[p][c] != below:
                    self._fold(self.next[p][c], below)
            else:
                self.next[p][c] = below

    def _merge(self) -> None:
        """Red states are final; a blue successor is merged with the first compatible red, else turns red."""
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            p, c = blue.pop(0)
            q = self.next[p][c]
            if q in red:
                continue
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            blue = [(r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in red]
        self.red = red

    def symbols(self, token: str) -> list[str]:
        n = next((n for n in range(1, len(token) + 1) if token[:n] not in self.starts), len(token) + 1) - 1
        return [f"'{c}" for c in token[:n]] + classes(token[n:])

    def _logs(self, few: float = 0.05) -> None:
        """Log probabilities of characters by state; one not seen in a state has `few` counts there and does not leave it."""
        kinds = len(CLASS_OF) + len(MARKS)
        self.log = {q: {c: math.log((n + few) / (self._total(q) + few * kinds)) - LOG_SIZE.get(c, 0.0) for c, n in self.times[q].items()} for q in self.red}
        self.unseen = {q: math.log(few / (self._total(q) + few * kinds)) for q in self.red}
        self.next = {q: self.next[q] for q in self.red}  # the merged tree has served
        del self.times, self.ends

    def lengths(self, strings: list[str], few: float = 0.02) -> None:
        n = len(strings) + few * 256
        self.size = {k: math.log((c + few) / n) for k, c in Counter(map(len, strings)).items()}
        self.other_size, self.longest = math.log(few / n), max(self.size, default=0)

    def walk(self, text: str, drop: float = 4.3, far: float = 16.0):
        """Log probability of each beginning of `text`, until it falls `far` behind `drop` a character."""
        at, total, literal = 0, 0.0, True
        for n, c in enumerate(text, 1):
            literal = literal and text[:n] in self.starts
            symbol = f"'{c}" if literal else CLASS_OF.get(c, c)
            p = self.log[at].get(symbol)
            total, at = (total + self.unseen[at], at) if p is None else (total + p, self.next[at][symbol])
            if total + drop * n < -far:
                return
            yield total


class Chain:
    """Ordinary tokens of one kind: what class of character follows what."""

    def __init__(self, tokens: list[str], few: float = 0.3):
        times: dict[str, Counter] = defaultdict(Counter)
        for t in tokens:
            for a, b in zip(["", *classes(t)], classes(t), strict=False):
                times[a][b] += 1
        kinds = [*LOG_SIZE, *sorted(MARKS)]
        self.log = {(a, b): math.log((times[a][b] + few) / (times[a].total() + few * len(kinds))) - LOG_SIZE.get(b, 0.0) for a in ("", *kinds) for b in kinds}


class SecretModel:
    """One automaton per format, chains of ordinary tokens, and a margin fitted so that no ordinary token of a sample passes."""

    def __init__(self, credentials: dict[str, list[str]] | None = None, plain: dict[str, list[str]] | None = None, margin: float | None = None, spare: float = 4.0):
        credentials = labelled() if credentials is None else credentials
        self.automata = {}
        for name, words in sorted(credentials.items()):
            self.automata[name] = Automaton(words)
            self.automata[name].lengths(words)
        self.chains = [Chain(t) for _, t in sorted((plain or ordinary()).items())]
        self.longest = max((a.longest for a in self.automata.values()), default=0)
        if margin is None:
            held = [t for ts in (plain or ordinary(seed=31)).values() for t in ts]
            margin = max([0.0, *(c[0] for t in held for c in self.candidates(t))]) + spare
        self.margin = margin

    def candidates(self, run: str, least: float = -math.inf) -> list[tuple[float, int, int, str]]:
        """(log-likelihood ratio, start, end, format) of every part of a run that begins and ends at its ends or at marks, best first.

        The background of a part is the chain that fits it best."""
        symbols = classes(run)
        sums = [list(accumulate((c.log[a, b] for a, b in zip(["", *symbols], symbols, strict=False)), initial=0.0)) for c in self.chains]
        found = []
        for a in [0, *(i + 1 for i, c in enumerate(run) if c in MARKS)]:
            if len(run) - a < SHORTEST:
                break
            for name, automaton in self.automata.items():
                for n, total in enumerate(automaton.walk(run[a : a + self.longest + 1]), 1):
                    if n >= SHORTEST and (a + n == len(run) or run[a + n] in MARKS):
                        ratio = total + automaton.size.get(n, automaton.other_size) - max(s[a + n] - s[a] for s in sums)
                        if ratio > least:
                            found.append((ratio, a, a + n, name))
        return sorted(found, key=lambda f: (-f[0], f[1], -f[2], f[3]))

    def learned(self, run: str) -> list[tuple[int, int, str]]:
        """The spans of a run above the margin that do not overlap and have the highest sum of ratios over the margin.

        Of the formats of one part the most likely stands, of equal ones the first by name; of equal sums the one of fewer
        and earlier spans."""
        parts: dict[tuple[int, int], tuple[float, str]] = {}
        for ratio, a, b, name in self.candidates(run, self.margin):
            parts.setdefault((a, b), (ratio - self.margin, name))
        best: list[tuple[float, list]] = [(0.0, [])]  # by end, the best sum of what ends there or before
        ends = [0]
        for (a, b), (gain, name) in sorted(parts.items(), key=lambda x: (x[0][1], x[0][0])):
            total, taken = best[bisect_right(ends, a) - 1]
            if total + gain > best[-1][0]:
                now = total + gain, [*taken, (a, b, name)]
                if ends[-1] == b:
                    best[-1] = now
                else:
                    ends.append(b)
                    best.append(now)
        return best[-1][1]

    def kind(self, token: str) -> str | None:
        """The format of a whole token, or None."""
        return next((name for a, b, name in self.learned(token) if (a, b) == (0, len(token))), None)

    def spans(self, text: str | None) -> tuple[list, list]:
        """(base spans, learned spans) as (start, place of the kind, kind, end)."""
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        edge = np.diff(IS_TOKEN[raw].astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        base = []
        if len(starts) and (ends - starts).max() >= 12 and (":" in text or "=" in text):
            base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        long = ends - starts >= SHORTEST
        if not long.any():
            return base, []
        starts, ends = starts[long], ends[long]
        points = np.cumsum((raw & 0xC0) != 0x80)
        found = []
        for a, b in zip((points[starts] - 1).tolist(), points[ends - 1].tolist(), strict=True):
            token = text[a:b]
            base += [(a + m.start(), 1, "access", a + m.end()) for m in ACCESS.finditer(token) if len(m[0]) >= 18]
            base += [(a + m.start(), 2, "hex", a + m.end()) for m in HEX.finditer(token) if len(m[0]) >= 16]
            found += [(a + x, 3, name, a + y) for x, y, name in self.learned(token)]
        base.sort()
        # what a base span holds is known; one that reaches beyond it is reported too
        first, last = [s[0] for s in base], list(accumulate((s[3] for s in base), max))
        found = [f for f in found if not (n := bisect_right(first, f[0])) or last[n - 1] < f[3]]
        return base, found

    def report(self, texts: list[str | None]) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, found = self.spans(text)
            said = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + found))))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """`docs` with a struct `_secrets`: counts by kind, base_sha256, and all spans as kind:start:end."""
    model = model or SecretModel()

    @pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        return model.report(texts.tolist())

    return docs.withColumn("_secrets", found("text"))
