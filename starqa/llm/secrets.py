"""Secrets in texts: three patterns, and a battery of randomness tests for everything else."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starqa.llm.common import chunks
from starqa.sources.storage import stored

#: The kinds in their order, and what a match of each must have.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: The method's candidates: runs of this length of characters that encodings use.
LEAST_CHARS = 20
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
#: A token whose battery says "not random" with less than this is not one.
BATTERY = 0.001
#: Share of ordinary strings among all that the tests add, at most.
FALSE_SHARE = 0.001

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encodings by size; a token has the first that holds all its characters.  Digits alone are
#: not tested: ordinary numbers are as even as random ones.
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("letters", LOWER),
    ("LETTERS", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("any", UPPER + LOWER + DIGITS + "+/-_="),
)
#: Letters per 1,000 of ordinary text, a to z; digits per 1,000 of ordinary numbers, 0 to 9.
LETTER_WEIGHTS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
DIGIT_WEIGHTS = (220, 180, 120, 80, 70, 90, 60, 55, 55, 70)
#: Characters of ordinary identifiers: small letters, capitals, digits, each other sign.
SHARES = (0.87, 0.06, 0.04, 0.006)


def _ordinary() -> dict[str, float]:
    small, capital, digit, sign = SHARES
    weights = {c: small * w / sum(LETTER_WEIGHTS) for c, w in zip(LOWER, LETTER_WEIGHTS)}
    weights |= {c: capital * w / sum(LETTER_WEIGHTS) for c, w in zip(UPPER, LETTER_WEIGHTS)}
    weights |= {c: digit * w / sum(DIGIT_WEIGHTS) for c, w in zip(DIGITS, DIGIT_WEIGHTS)}
    return weights | dict.fromkeys("+/-_=", sign)


ORDINARY = _ordinary()


def _unevenness(alphabet: str) -> float:
    """Chi-squared that each character of an ordinary string adds: its distance from an even alphabet."""
    total = sum(ORDINARY[c] for c in alphabet)
    return len(alphabet) * sum((ORDINARY[c] / total) ** 2 for c in alphabet) - 1


#: By name: its characters' places, and the unevenness of ordinary strings.
ALPHABETS = {name: ({c: i for i, c in enumerate(chars)}, _unevenness(chars)) for name, chars in ENCODINGS}


def _above(z: float) -> float:
    """The share of a normal distribution above z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_z(x: float, df: float) -> float:
    """The normal value that stands for chi-squared x, by the cube root (Wilson and Hilferty)."""
    spread = 2 / (9 * df)
    return ((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that has all characters; none for digits alone."""
    used = set(token)
    if used <= set(DIGITS):
        return None
    return next(name for name, (places, _) in ALPHABETS.items() if used <= places.keys())


def battery(token: str) -> tuple[str, float, float] | None:
    """Encoding, how likely a random string is no more even than this, how likely an ordinary one is no less.

    The first is Fisher's sum of three tests against an even, independent
    choice of characters: chi-squared of the alphabet, runs above and below
    its middle, correlation of neighbours.  The second sets the same
    chi-squared against the one that ordinary text of that length has, a
    non-central one, so that a short string can hardly be told from a word.
    None where no encoding is tested.
    """
    token = token.rstrip("=")
    encoding = encoding_of(token) if len(token) >= LEAST_CHARS else None
    if encoding is None:
        return None
    places, uneven = ALPHABETS[encoding]
    size, n = len(places), len(token)
    values = [places[c] for c in token]
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    chi = size / n * sum(c * c for c in counts.values()) - n
    even = _above(_chi_z(max(chi, 0.0), size - 1))

    high = [v >= size / 2 for v in values]
    up = sum(high)
    down = n - up
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if up and down:
        expected = 2 * up * down / n + 1
        variance = max((expected - 1) * (expected - 2) / (n - 1), 1e-9)
        mixed = 2 * _above(abs(runs - expected) / math.sqrt(variance))
    else:
        mixed = 2.0 ** (1 - n)

    mean = sum(values) / n
    apart = [v - mean for v in values]
    square = sum(a * a for a in apart)
    serial = sum(a * b for a, b in zip(apart, apart[1:])) / square if square else 1.0
    free = 2 * _above(abs(serial + 1 / n) * math.sqrt(n))

    half = -sum(math.log(max(p, 1e-300)) for p in (even, mixed, free))
    random = math.exp(-half) * (1 + half + half * half / 2)

    extra, df = uneven * n, size - 1
    scale = (df + 2 * extra) / (df + extra)
    ordinary = _above(-_chi_z(max(chi, 1e-9) / scale, (df + extra) / scale))
    return encoding, min(random, 1.0), min(max(ordinary, 1e-300), 1.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, place of the kind, end of what the three patterns find, in order."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float, float]]:
    """Start, end, encoding and both likelihoods of every token that the patterns have not taken."""
    found = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if not any(s < end and start < e for s, _, e in base) and (tested := battery(m.group())):
            found.append((start, end, *tested))
    return found


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
CANDIDATE = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("random", pa.float64()), ("ordinary", pa.float64())]
)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        base, more = [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            # What any pattern but the first finds is part of a long word.
            words = text.split() if text else []
            if not words or max(map(len, words)) < 16 and not any(k in text.lower() for k in KEYWORDS):
                base.append([])
                more.append([])
                continue
            spans = base_spans(text)
            base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            names = ("start", "end", "encoding", "random", "ordinary")
            more.append([dict(zip(names, c)) for c in candidates(text, spans)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(more, pa.list_(CANDIDATE))],
            names=["doc_id", "base", "candidates"],
        )


def threshold(levels: list[tuple[int, int]], total: int, share: float) -> float | None:
    """The largest level below which at most ``share`` of the tokens are expected to be ordinary.

    ``levels``: hundredths of powers of ten and the number of tokens in each
    (Benjamini and Hochberg's rule on that grid).  None if there is none.
    """
    best, below = None, 0
    for level, count in sorted(levels):
        below += count
        if total * 10 ** ((level + 1) / 100) <= share * below:
            best = (level + 1) / 100
    return best


def find_secrets(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = FALSE_SHARE
) -> DataFrame:
    """One row per document: doc_id, ``found`` (kind, start, end by start) and ``tests`` of the random ones.

    Kinds ``assign``, ``access`` and ``hex`` are patterns; ``random`` are other
    runs of 20 or more characters that pass the battery and are no ordinary
    strings.  Their level is set over the tokens of all documents, so that at
    most ``share`` of what is found is expected to be ordinary; a token's
    likelihood is divided by its length against the mean length, so that long
    ones need less.  Places are code points, ends exclusive.

    Null and empty texts have no secret.  Every row is read by itself: repeated
    rows give repeated results, an empty table none.  Columns of the input
    besides id and text are not used.
    """
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = stored(
        slim.mapInArrow(
            _scan,
            f"doc_id {kind}, base array<struct<kind:string,start:long,end:long>>, "
            "candidates array<struct<start:long,end:long,encoding:string,random:double,ordinary:double>>",
        ),
        "secret-candidates",
    )
    tokens = rows.select(F.explode("candidates").alias("c")).select("c.*")
    total, mean = tokens.agg(F.count("*"), F.avg(F.col("end") - F.col("start"))).first()
    limit = None
    if total:
        # At most some 30,000 levels: a double has no smaller power of ten.
        tested = tokens.where(F.col("random") >= BATTERY).select(_level(F.struct("*"), mean).alias("level"))
        counts = tested.groupBy(F.floor(100 * F.col("level")).alias("level")).count()
        limit = threshold([tuple(r) for r in counts.collect()], total, share)
    none = F.filter("candidates", lambda c: F.lit(False))
    kept = none if limit is None else F.filter("candidates", lambda c: (c["random"] >= BATTERY) & (_level(c, mean) < limit))
    added = F.transform(kept, lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", F.array_sort(F.concat("base", added), _by_place).alias("found"), kept.alias("tests"))


def _level(token: Column, mean: float) -> Column:
    """The power of ten of a token's likelihood to be ordinary, divided by its length against the mean."""
    return F.log10(token["ordinary"] * mean / (token["end"] - token["start"]))


def _by_place(a: Column, b: Column) -> Column:
    """Below zero if span a is written before b."""
    place = lambda s: s["start"] * len(KINDS) + F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.signum(place(a) - place(b)).cast("int")


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
