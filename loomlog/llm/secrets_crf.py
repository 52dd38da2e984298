"""Secret scanning with a linear-chain conditional random field.

Tokens get a label: secret begin (B), inside (I) or outside (O). Features are the token's shape, the shapes of its
neighbours and of the file (has it a secret's keyword, is it rich in digits), alone and in pairs, and the two words before a token that
may be a value; Viterbi decodes each line. Three plain patterns (assign, access, hex) are always reported as well; the CRF's
spans are added to them.

The CRF is fitted by gradient ascent on the log-likelihood of windows of tokens from a bounded sample: at most ``windows`` windows of each
of ``train_docs`` documents with and as many without a base finding. Labels are the values that the base patterns find; so that it
learns what the patterns miss, each window with a value comes ``variants`` times more with the value cut short or replaced by random characters,
the sign between keyword and value replaced or dropped, the keyword changed or, before long values, dropped, and other words before it.

No secret begins with a plain word or a mark (the begin label is barred there), so only lines with a telling token are
decoded. Lines are independent, whole texts are read.

Defined cases: null and empty texts have no finding; spans count code points, end exclusive; ids may be null or
repeat, other columns pass through; rows that repeat a text have the same findings; an empty table gives an empty table; without
training findings the CRF adds nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, text_batches

# The base patterns.
KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex")


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(kind number, start, kind, end, value start) of the base findings, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(0, m.start(), "assign", m.end(), m.start(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


TOKEN = re.compile(r"[A-Za-z0-9_+/.-]+|[^\sA-Za-z0-9_+/.-]")
TELLING = re.compile(r"[0-9=:_]|[A-Z]{8}|" + KEYWORD)
PLAIN, MARK, QUOTE, SIGN, KEY, DIGITS, LONG_DIGITS, UPPER, HEX_SHORT, HEX_LONG, MIXED_SHORT, MIXED, MIXED_LONG, RUN, NAME, EDGE = range(16)
SHAPES = 16
QUIET = (PLAIN, MARK, QUOTE, EDGE)  #: shapes of tokens in which TELLING finds nothing
KEY_END = re.compile(KEYWORD + r"\Z")
TURN = re.compile(r"(?<=[0-9])(?![0-9])(?!\Z)|(?<=[^0-9])(?=[0-9])")  #: where digits begin or end
IS_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")


def shape(token: str) -> int:
    if len(token) == 1 and not token.isalnum():
        return SIGN if token in "=:" else QUOTE if token in "\"'" else MARK
    if KEY_END.search(token):
        return KEY
    digits = sum(c in "0123456789" for c in token)
    if not digits:
        return NAME if "_" in token else UPPER if re.search(r"[A-Z]{8}", token) else PLAIN
    if digits == len(token):
        return LONG_DIGITS if digits > 8 else DIGITS
    if len(token) >= 8 and IS_HEX.match(token):
        return HEX_LONG if len(token) >= 16 else HEX_SHORT
    if len(TURN.findall(token)) < 3:  # a word with a number, an address, a version
        return RUN
    return MIXED_LONG if len(token) >= 20 else MIXED if len(token) >= 8 else MIXED_SHORT


O, B, I = range(3)  # noqa: E741
FILES = 4


def file_class(text: str) -> int:
    """Features of the whole text: holds a keyword; has a digit in a hundred characters."""
    low = text.lower()
    digits = sum(low.count(c) for c in "0123456789")
    return 2 * any(h in low for h in HINTS) + (digits * 100 > len(low))


WORDS_BEFORE = 256  #: word features: hash values of a word


def word_number(token: str) -> int:
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % WORDS_BEFORE


def features(shapes: np.ndarray, file: int, tokens: list[str]) -> np.ndarray:
    """Active features of each token, one column per template; the last feature of all is that of no word."""
    s = SHAPES
    pad = np.concatenate(([EDGE, EDGE, EDGE], shapes, [EDGE]))
    now, p1, p2, p3, nx = pad[3:-1], pad[2:-2], pad[1:-3], pad[:-4], pad[4:]
    parts, at = [now, p1 * s + now, p2 * s + now, p3 * s + now, nx * s + now, file * s + now], 0
    out = []
    for k, x in enumerate(parts):
        out.append(x + at)
        at += s if k == 0 else s * (FILES if k == 5 else s)
    # Words before a token that may be a value: marks are passed over.
    one, two = np.full(len(shapes), N_FEATURES - 1), np.full(len(shapes), N_FEATURES - 1)
    for k in np.flatnonzero(~IS_QUIET[shapes]).tolist():
        before = [j for j in range(max(0, k - 5), k) if tokens[j][0].isalnum()][-2:]
        if before:
            one[k] = at + word_number(tokens[before[-1]])
        if len(before) > 1:
            two[k] = at + WORDS_BEFORE + word_number(tokens[before[0]])
    return np.stack([*out, one, two], axis=1)


N_FEATURES = SHAPES * (1 + 4 * SHAPES + FILES) + 2 * WORDS_BEFORE + 1
IS_QUIET = np.isin(np.arange(SHAPES), QUIET)


@dataclass
class Window:
    """Tokens of one line with their labels, and the class of the file that they stand in."""

    tokens: list[str]
    labels: list[int]
    file: int

    def allowed(self) -> list[int]:
        """The labels, with plain words at the begin of a value left out: only patterns can tell those."""
        out: list[int] = []
        for token, label in zip(self.tokens, self.labels, strict=True):
            begins = label == B or (label == I and out[-1:] in ([], [O]))
            out.append(label if not begins else O if IS_QUIET[shape(token)] else B)
        return out

    def features(self) -> np.ndarray:
        return features(np.array([shape(t) for t in self.tokens]), self.file, self.tokens)


class Crf:
    """Weights of a linear-chain CRF over O, B, I: ``w[feature, label]``, ``t[before, label]``; a line begins after O."""

    def __init__(self):
        self.w, self.t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
        self.banned = np.zeros((3, 3))
        self.banned[O, I] = -1e9  # inside needs a begin
        self.w[list(QUIET), B] = -1e9  # no secret begins with a quiet shape: a line of quiet shapes decodes to O throughout

    def fit(self, windows: list[Window], steps: int = 150, rate: float = 0.15, decay: float = 3e-4) -> Crf:
        """Full-batch gradient ascent (Adam) on the penalised log-likelihood, by forward-backward over all windows at once."""
        n, most = len(windows), max(len(x.tokens) for x in windows)
        x = np.full((n, most, 8), N_FEATURES - 1)
        y, on = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
        for k, window in enumerate(windows):
            m = len(window.tokens)
            x[k, :m], y[k, :m], on[k, :m] = window.features(), window.allowed(), True
        gold = np.zeros((n, most, 3))
        np.put_along_axis(gold, y[:, :, None], 1.0, axis=2)
        before = np.concatenate((np.zeros((n, 1), np.int64), y[:, :-1]), axis=1)
        pairs = np.bincount((before * 3 + y)[on], minlength=9).reshape(3, 3)
        flat = x[on].T
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.t)]
        for step in range(1, steps + 1):
            e, t = self.w[x].sum(axis=2), self.t + self.banned
            a, b = np.empty((n, most, 3)), np.zeros((n, most, 3))
            a[:, 0] = t[O] + e[:, 0]
            for i in range(1, most):
                a[:, i] = np.where(on[:, i, None], np.logaddexp.reduce(a[:, i - 1, :, None] + t, axis=1) + e[:, i], a[:, i - 1])
            for i in range(most - 2, -1, -1):
                b[:, i] = np.where(on[:, i + 1, None], np.logaddexp.reduce(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2), 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None])
            both = np.exp(np.minimum(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None], 0))
            dt = (pairs - (both * on[:, 1:, None, None]).sum(axis=(0, 1))) / n
            dt[O] -= p[:, 0].sum(axis=0) / n
            de = (gold - p)[on]
            dw = np.stack([sum(np.bincount(col, de[:, label], N_FEATURES) for col in flat) for label in range(3)], axis=1) / n
            for value, grad, (m1, m2) in ((self.w, dw - decay * self.w, moments[:2]), (self.t, dt - decay * self.t, moments[2:])):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                value += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            self.w[-1], self.w[list(QUIET), B] = 0, -1e9  # no word says nothing; begins stay as they are
        return self

    def decode(self, tokens: list[str], file: int) -> np.ndarray:
        """The best labels (Viterbi)."""
        shapes = np.array([shape(x) for x in tokens])
        e, t = self.w[features(shapes, file, tokens)].sum(axis=1), self.t + self.banned
        n = len(shapes)
        back = np.zeros((n, 3), np.int8)
        (o, b, i), rows, m = (t[O] + e[0]).tolist(), e.tolist(), t.tolist()
        for k in range(1, n):
            best = []
            for y in range(3):
                c = (o + m[0][y], b + m[1][y], i + m[2][y])
                j = 0 if c[0] >= c[1] and c[0] >= c[2] else 1 if c[1] >= c[2] else 2
                back[k, y] = j
                best.append(c[j] + rows[k][y])
            o, b, i = best
        y = int(np.argmax((o, b, i)))
        out = np.empty(n, np.int8)
        for k in range(n - 1, -1, -1):
            out[k] = y
            y = int(back[k, y])
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the decoded secrets."""
        out, at, file = [], 0, None
        for line in text.split("\n"):
            if TELLING.search(line):
                file = file_class(text) if file is None else file
                where = [m.span() for m in TOKEN.finditer(line)]
                if where:
                    labels = self.decode([line[a:b] for a, b in where], file)
                    for k in np.flatnonzero(labels == B).tolist():
                        end = k + 1
                        while end < len(where) and labels[end] == I:
                            end += 1
                        out.append((at + where[k][0], at + where[end - 1][1]))
            at += len(line) + 1
        return out


def training_windows(text: str, most: int) -> list[tuple[list[str], list[int], int]]:
    """(tokens, labels, file class) about telling tokens, labelled by the base findings' values; at most ``most``, those with values first."""
    values = [(v, e) for _, _, _, e, v in base_spans(text)]
    out, at, file = [], 0, file_class(text)
    for line in text.split("\n"):
        if TELLING.search(line):
            where = [m.span() for m in TOKEN.finditer(line)]
            labels = []
            for a, b in where:
                inside = [v for v, e in values if v < at + b and at + a < e]
                labels.append(O if not inside else B if at + a <= inside[0] or not labels or labels[-1] == O else I)
            # Plain stretches far from anything telling add no information.
            tell = [k for k, (a, b) in enumerate(where) if labels[k] or shape(line[a:b]) not in QUIET]
            last = -1
            for k in tell:
                if k > last:
                    lo, hi = max(0, k - 6), min(len(where), k + 12)
                    while hi < len(where) and labels[hi] == I:
                        hi += 1
                    out.append(([line[a:b] for a, b in where[lo:hi]], labels[lo:hi], file))
                    last = hi - 1
        at += len(line) + 1
    return sorted(out, key=lambda x: not any(x[1]))[:most]


SIGNS = ("=", ":", "is", "was", "")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = ("0123456789abcdef", LETTERS + "0123456789", LETTERS + LETTERS.upper() + "0123456789", LETTERS.upper() + "0123456789")


def variant(window: Window, draw: np.random.Generator) -> Window:
    """The window with its first value, keyword and sign changed at random."""
    tokens, labels = list(window.tokens), list(window.labels)
    at = labels.index(B)
    end = at + 1
    while end < len(labels) and labels[end] == I:
        end += 1
    value = "".join(tokens[at:end])
    if draw.random() < 0.3 and len(value) > 12:
        value = value[: int(draw.integers(8, len(value)))]
    else:
        letters = ALPHABETS[int(draw.integers(len(ALPHABETS)))]
        value = "".join(letters[i] for i in draw.integers(0, len(letters), int(draw.integers(8, 48))))
    head = tokens[:at]
    while head and len(head[-1]) == 1 and not head[-1].isalnum():  # quotes and the sign
        head.pop()
    if head and KEY_END.search(head[-1]):
        head.pop()
    if not re.search("[0-9]", value):
        value = f"{value[:3]}{int(draw.integers(10))}{value[4:]}"
    # Other words around it: which words those are says nothing about a secret.
    head = ["".join(LETTERS[i] for i in draw.integers(0, 26, int(draw.integers(2, 9)))) if shape(x) == PLAIN else x for x in head]
    keep = labels[: len(head)]
    key = "" if len(value) >= 24 and draw.random() < 0.3 else KEYWORDS[int(draw.integers(len(KEYWORDS)))]
    middle = [x for x in (key, SIGNS[int(draw.integers(len(SIGNS)))] if key else "") if x]
    tail, rest = tokens[end:], labels[end:]
    if draw.random() < 0.3:
        middle.append('"')
    else:
        while tail and shape(tail[0]) == QUOTE:
            tail, rest = tail[1:], rest[1:]
    made = TOKEN.findall(value)
    return Window(head + middle + made + tail, keep + [O] * len(middle) + [B] + [I] * (len(made) - 1) + rest, window.file if not key else window.file | 2)


def train(docs: DataFrame, text: str = "text", train_docs: int = 300, windows: int = 4, variants: int = 8) -> Crf:
    """A CRF from at most ``windows`` windows of at most ``train_docs`` documents with a base finding and as many others, chosen by a hash of the text."""
    words = r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    pool = docs.select(F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.col(text).rlike(words).alias("found")).filter("t IS NOT NULL")
    hashes = materialise(pool.select("found", "h").distinct(), "crf-sample")
    chosen = [r["h"] for found in (True, False) for r in hashes.filter(F.col("found") == found).orderBy("h").limit(train_docs).collect()]
    if not chosen:
        return Crf()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, t in zip(batch["h"], batch["t"], strict=True):
                yield pd.DataFrame([(h, k, *w) for k, w in enumerate(training_windows(t, windows))], columns=["h", "k", "tokens", "labels", "file"])

    # Copies of a text give the same windows.
    sample = pool.filter(F.col("h").isin(chosen)).select("h", "t").mapInPandas(cut, "h long, k int, tokens array<string>, labels array<int>, file int").distinct().orderBy("h", "k").collect()
    draw, every = np.random.default_rng(7), []
    for r in sample:
        own = Window(list(r["tokens"]), list(r["labels"]), r["file"])
        every += [own, *(variant(own, draw) for _ in range(variants if B in own.labels else 0))]
    return Crf().fit(every) if any(B in x.labels for x in every) else Crf()


def scan_text(text: str | None, crf: Crf) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    added = []
    if crf.w.any():
        for a, b in crf.spans(text):
            if not any(s < b and a < e for _, s, _, e, _ in base):
                added.append(("crf", a, b))
    spans = [(kind, s, e) for _, s, kind, e, _ in base]
    show = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
    every = sorted(spans + added, key=lambda x: (x[1], (*KINDS, "crf").index(x[0])))
    return (*(sum(k == kind for k, _, _ in spans) for kind in KINDS), hashlib.sha256(show(spans).encode()).hexdigest(), show(every))


def scan(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: counts of base findings, their digest, and all spans as a string."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([scan_text(t, shared.value) for t in batch], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.withColumn("secrets", find(F.col(text)))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs.select("doc_id", "text"), train(docs)).select("doc_id", "secrets.*")
