"""Secret scan: fixed patterns, and a battery of randomness tests on everything that looks encoded.

A candidate is a run of 20 or more characters of the usual encodings, with the padding that ends
it; "=" before a value, as in name=value, separates. The encoding of a candidate is inferred
from the symbols it uses; the battery asks for the uniformity of symbols and of symbol classes
(chi-squared), the number of runs of letters, and the serial correlation. The
p-values of randomness are combined by Fisher's method to one statistic, -log10(p).

Ordinary text has large statistics, the larger the longer it is. At each length the statistic of
ordinary strings, words glued together with and without capitals and numbers, is modelled by a
normal distribution of its logarithm. The lower tail of it is a candidate's p-value under the
hypothesis that it is ordinary. Over the whole table, in each length band on its own, the
Benjamini-Hochberg procedure rejects that hypothesis at a given false-discovery rate, and what is
rejected is reported as ``random``. So the rate bounds the share of ordinary strings among what is
reported.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support

KINDS = ("assign", "access", "hex", "random")
#: The base patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=*(?![A-Za-z0-9+/_=-])|(?==))")
#: The encodings, by size of alphabet: the first whose symbols cover the candidate is inferred.
ENCODINGS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
TABLES = [{c: i for i, c in enumerate(symbols)} for symbols in ENCODINGS]
#: Upper ends of the length bands, and the lengths at which ordinary text is modelled; the model is interpolated between them.
BANDS, LENGTHS = (24, 32, 48, 64, 128), (20, 24, 28, 32, 40, 48, 64, 96, 128, 256)
#: Steps of -log10(p) in the histogram of p-values.
STEP, STEPS = 0.1, 400
#: What ordinary strings are glued of: common English words.
ORDINARY = (
    "about after again all also another any because before being between both but came come could day did does down each even every few find first for from get give good great had hand hard has have "
    "head help her here high him his home house how into just keep kind know large last left life light like line little live long look made make man many may mean men might more most much must name "
    "near need never new next night now number off often old only open other our over own page paper part people place point read right said same saw say school see set she show side small some something "
    "sound still such take tell than that the their them then there these they thing think this those three through time together too tree try turn two under until upon use very want water way well went "
    "were what when where which while white who why will with word work world would write year you young your"
).split()


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_tail(value: float, freedom: float) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty."""
    if value <= 0:
        return 1.0
    spread = 2.0 / (9.0 * freedom)
    return 0.5 * math.erfc(((value / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def fisher(ps: list[float]) -> float:
    """Combined p-value: the tail of chi-squared with 2k degrees has a closed form."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    logs = [k * math.log(half) - math.lgamma(k + 1) if half else 0.0 for k in range(len(ps))]
    most = max(logs)
    return math.exp(min(0.0, -half + most + math.log(sum(math.exp(x - most) for x in logs))))


def chi_squared(counts: np.ndarray, shares: np.ndarray) -> float:
    expected = shares * counts.sum()
    return chi_tail(float(((counts - expected) ** 2 / expected).sum()), len(shares) - 1)


def uniformity(values: np.ndarray, size: int) -> float:
    """Chi-squared over all symbols of the alphabet.

    There are often fewer characters than symbols, so the tail is that of a scaled chi-squared with
    the statistic's exact mean (size - 1) and variance (2 (size - 1) (n - 1) / n).
    """
    n = len(values)
    counts = np.bincount(values, minlength=size)
    scale = (n - 1) / n
    return chi_tail((float((counts * counts).sum()) * size / n - n) / scale, (size - 1) / scale)


def battery(text: str) -> float:
    """p-value of the hypothesis that ``text`` is random in its inferred encoding; 0 if it fits none."""
    body = text.rstrip("=")
    used = set(body)
    for symbols, table in zip(ENCODINGS, TABLES, strict=True):
        if used <= table.keys():
            break
    else:
        return 0.0
    size, n = len(symbols), len(body)
    values = np.fromiter((table[c] for c in body), dtype=np.int64, count=n)
    kind = lambda s: np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s])
    whole = np.bincount(kind(symbols), minlength=4) / size
    own = np.bincount(kind(body), minlength=4)
    ps = [uniformity(values, size), chi_squared(own[whole > 0], whole[whole > 0])]
    letter = kind(symbols) == (2 if any(c.islower() for c in symbols) else 1)
    high = letter[values]
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        ps.append(float((letter if ups else ~letter).mean()) ** n)
    off = values - values.mean()
    square = float((off * off).sum())
    ps.append(normal_tail((float((off[1:] * off[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square else 0.0)
    return fisher(ps)


def ordinary(length: int, rng: random.Random) -> str:
    """Common words, joined as they are or with capitals; half of the strings end with a number."""
    capitals, number, out = rng.random() < 0.5, str(rng.randrange(10 ** rng.randrange(1, 5))) if rng.random() < 0.5 else "", ""
    while len(out) < length:
        word = rng.choice(ORDINARY)
        out += word.capitalize() if capitals else word
    return out[: length - len(number)] + number


def statistic(text: str) -> float:
    """-log10 of the battery's p-value, as a logarithm that is finite."""
    return math.log(0.25 - math.log10(max(battery(text), 1e-300)))


@lru_cache(maxsize=1)
def ordinary_models(number: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of the statistic of ordinary strings at some lengths. They depend on nothing but ``ORDINARY``."""
    rng = random.Random(3)
    found = [np.array([statistic(ordinary(n, rng)) for _ in range(number)]) for n in LENGTHS]
    return np.log(LENGTHS), np.array([x.mean() for x in found]), np.array([x.std() for x in found])


def ordinary_tail(text: str) -> float:
    """p-value of the hypothesis that ``text`` is ordinary: how seldom ordinary text of its length looks as random."""
    lengths, means, spreads = ordinary_models()
    at = math.log(len(text))
    return 0.5 * math.erfc((np.interp(at, lengths, means) - statistic(text)) / np.interp(at, lengths, spreads) / math.sqrt(2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def band(n: int) -> int:
    return sum(n > b for b in BANDS)


def scanned(text: str | None) -> tuple:
    """Base spans and their digest, and the candidates that lie outside of them with band and step of -log10(p)."""
    text = text or ""
    base = base_spans(text)
    free: list[tuple[int, int, int, int]] = []
    starts, reach = [s for s, _, _ in base], []
    for _, _, e in base:
        reach.append(max(e, reach[-1]) if reach else e)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)  # base spans that begin before its end
        if not before or reach[before - 1] <= a:
            free.append((a, b, band(b - a), min(STEPS, int(-math.log10(max(ordinary_tail(m[0]), 1e-300)) / STEP))))
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), [list(x) for x in base], [list(x) for x in free])


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<array<int>>, free array<array<int>>"


def scan_texts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scanned(t) for t in texts], columns=[c.split()[0] for c in SCANNED.split(", ")])


def cut(counts: np.ndarray, rate: float) -> int:
    """The step of -log10(p) from which on Benjamini-Hochberg rejects, given how many p-values lie in each step.

    A step's p-values count as its largest, so nothing is rejected that the procedure would not reject.
    """
    upto = np.cumsum(counts[::-1])[::-1]  # p-values at or below the step's
    passing = np.flatnonzero((counts > 0) & (10.0 ** (-STEP * np.arange(len(counts))) <= rate * upto / max(upto[0], 1)))
    return int(passing[0]) if len(passing) else len(counts)


def cuts(found: DataFrame, rate: float) -> list[int]:
    """``cut`` of each length band. The histogram that comes to the driver has at most bands times ``STEPS`` rows."""
    each = found.select(F.explode("free").alias("x")).groupBy(F.col("x")[2].alias("band"), F.col("x")[3].alias("step")).count().collect()
    counts = np.zeros((len(BANDS) + 1, STEPS + 1))
    for r in each:
        counts[r["band"], r["step"]] = r["count"]
    return [cut(c, rate) for c in counts]


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rate: float = 0.02) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row.

    ``rate`` bounds the expected share of ordinary strings among the ``random`` spans. Spans count code
    points, ends are exclusive. The scan is written once to the shared folder; what is decided from the
    p-values of all rows is then applied to that table.

    Null and empty texts have no spans; very long texts are scanned whole; repeated rows are
    scanned alike; an empty table gives an empty table; other columns are not read.
    """
    support.short_batches(df.sparkSession)
    found = support.written(df.select(F.col(id_column).alias("doc_id"), F.pandas_udf(scan_texts, SCANNED)(F.col(text_column)).alias("s")).select("doc_id", "s.*"), "secrets")
    limits = F.array(*[F.lit(x) for x in cuts(found, rate)])
    kept = F.filter("free", lambda x: x[3] >= F.element_at(limits, x[2] + 1))
    every = F.array_sort(F.concat("base", F.transform(kept, lambda x: F.array(x[0], F.lit(len(KINDS) - 1), x[1]))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x[1] + 1), x[0].cast("string"), x[2].cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def op8(spark, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return scan(support.table(spark, sf_dir, "documents"))
