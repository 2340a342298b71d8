"""Personal data: candidate spans judged by boosted trees.

Fixed patterns give the base spans, which always stay. Generators of high recall propose
further spans of the same kinds: written-out e-mail addresses, phone numbers without a
plus, card numbers with other separators, long and bracketed ip addresses. Their format
and their context are features of gradient-boosted trees; a calibrated threshold for
each kind selects what is added. The trees are trained on candidates made by rule and on
candidates of a bounded sample of documents, where the base spans serve as positives.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import prepared, slices, table

KINDS = ("email", "ip", "card", "phone")
#: Documents and candidates of the corpus that the trees are trained on, and made examples.
SAMPLE_DOCS, SAMPLE_ROWS, MADE_ROWS, SEED = 1_000, 4_000, 3_000, 9
#: Trees, their depth, and the precision that a threshold has to reach on held-out rows.
TREES, DEPTH, RATE, PRECISION = 30, 3, 0.3, 0.98

# Base patterns. Possessive repeats and the look-behinds only keep them linear.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Generators.
_WIDE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+"
    r"(?: ?(?:@|\(at\)|\[at\]|\{at\}|＠) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63}+|(?:\.| dot )[A-Za-z0-9-]{2,63}+){1,4}"
    r"| at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{2,63}+){1,4})",
    re.I,
)
_AT_WORD = re.compile(r"＠|[(\[{]at[)\]}]| dot ", re.I)
_WIDE_IP = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{0,4}|(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9.])")
# Numbers are groups of digits; what may stand between two groups, and before and after a number that goes on.
_GROUP, _GAP = re.compile("[0-9]+"), re.compile(r"\)?[ ./\-–_]{0,2}\(?")
_JOINED_BEFORE, _JOINED_AFTER = re.compile(r"[0-9](\)?[ ./\-–_]{0,2}\(?)$"), re.compile(r"(\)?[ ./\-–_]{0,2}\(?)[0-9]")
CARD_DIGITS, PHONE_DIGITS = range(12, 20), range(7, 16)
_HINTS = {
    "phone": re.compile(r"(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono)\W{0,3}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W{0,3}$", re.I),
    "email": re.compile(r"(?:e-?mail|contact|write|mail|correo|courriel)\W{0,3}$", re.I),
    "ip": re.compile(r"(?:ip|host|server|address|addr|client)\W{0,3}$", re.I),
}
_WRONG = re.compile(r"(?:version|v|date|isbn|issn|order|no|nr|id|page|section|price|total|€|\$|invoice|build|release)\W{0,3}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, leftmost and not overlapping within a kind.

    Linear in the text: an address is found from its @, whose left side is the longest
    run of local characters after the last match.
    """
    out, last = [], 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that could be personal data; they may overlap, also with base spans."""
    return list(_candidates(text))


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    yield from _written(text)
    yield from _numbers(text)


def _written(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates that are no numbers: addresses, as they may be written out."""
    if "@" in text or _AT_WORD.search(text):
        yield from (("email", *m.span()) for m in _WIDE_EMAIL.finditer(text))
    if ":" in text or "." in text:
        yield from (("ip", *m.span()) for m in _WIDE_IP.finditer(text))


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Every run of whole neighbouring digit groups with the digits of a card or a phone.

    A group has a digit at least, so at most ``CARD_DIGITS[-1]`` runs end at a group.
    """
    groups: deque[tuple[int | None, int]] = deque(maxlen=CARD_DIGITS[-1])
    last = 0
    for m in _GROUP.finditer(text):
        start, end = m.span()
        if groups and not _GAP.fullmatch(text, last, start):
            groups.clear()
        last = end
        # A number begins at its bracket, and not inside of a word.
        begins = [i for i in (start - 1, start) if (i == start or i >= 0 and text[i] == "(") and not (i and _within(text[i - 1], "+"))]
        groups.append((begins[0] if begins else None, end - start))
        if end < len(text) and _within(text[end]):
            continue
        digits = 0
        for begin, size in reversed(groups):
            digits += size
            if digits > CARD_DIGITS[-1]:
                break
            if begin is not None and digits in CARD_DIGITS:
                yield "card", begin, end
            if begin is not None and digits in PHONE_DIGITS:
                yield "phone", begin, end


def _within(c: str, more: str = "") -> bool:
    return c.isascii() and c.isalnum() or c in more and c != ""


def _joined(gap: re.Match | None) -> float:
    """0 without a neighbouring number, 1 with one apart by space, 2 by anything else."""
    return 0.0 if gap is None else 1.0 if gap[1].strip(" ") in ("", "(") and gap[1] != "(" else 2.0


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    body, before = text[start:end], text[max(0, start - 24) : start]
    digits = _digits(body)
    groups = re.findall("[0-9]+", body)
    separators = re.findall(r"[^0-9A-Za-z]+", body)
    number = kind in ("card", "phone")
    joined = _joined(_JOINED_BEFORE.search(before)) if number else 0.0
    if joined:  # a word before several numbers says something of each
        before = text[max(0, start - 64) : start].rstrip("0123456789 ./-–_()")
    quads = kind == "ip" and len(groups) == 4 and all(int(g) <= 255 for g in groups)
    return [
        KINDS.index(kind),
        len(body),
        len(digits),
        len(digits) / len(body),
        len(groups),
        max((len(g) for g in groups), default=0),
        min((len(g) for g in groups), default=0),
        len(set(separators)),
        float(luhn(digits)) if digits else 0.0,
        float(digits[:1] in "3456" and digits != ""),
        float("(" in body),
        float("[" in body or "{" in body),
        body.count(":"),
        float("@" in body),
        float(bool(re.search(r"[(\[{]at|[(\[{]dot", body, re.I))),
        float(bool(re.search(r" (?:at|dot) ", body, re.I))),
        float(bool(re.search(r"(?:com|org|net|edu|gov|info|de|fr|es|uk|example|io)$", body, re.I))),
        float(quads),
        float(digits.startswith("00")),
        float(digits.startswith("0")),
        float(len(set(digits)) <= 3),
        float(bool(_HINTS[kind].search(before))),
        float(any(h.search(before) for k, h in _HINTS.items() if k != kind)),
        float(bool(_WRONG.search(before))),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}.*", body))),
        float(start > 0 and text[start - 1].isalnum()),
        float(end < len(text) and text[end].isalnum()),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        joined,
        _joined(_JOINED_AFTER.match(text, end)) if number else 0.0,
    ]


class Tree:
    """Regression tree on binned features: squared loss, grown level by level."""

    def __init__(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        self.split: dict[int, tuple[int, float]] = {}
        self.value: dict[int, float] = {}
        self._grow(0, x, g, h, np.arange(len(g)), depth)

    def _grow(self, node: int, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        if depth and len(rows) >= 20:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                lg, lh = np.cumsum(g[order])[cut], np.cumsum(h[order])[cut]
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] is None:
            self.value[node] = -total_g / (total_h + 1)
            return
        self.split[node] = (best[1], best[2])
        left = x[rows, best[1]] <= best[2]
        self._grow(2 * node + 1, x, g, h, rows[left], depth - 1)
        self._grow(2 * node + 2, x, g, h, rows[~left], depth - 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """``score`` of every row of a matrix."""
        size = 2 ** (DEPTH + 1) - 1
        feature, at, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        for node, (f, threshold) in self.split.items():
            feature[node], at[node] = f, threshold
        # Below a leaf all nodes have its value; every row then goes down to the last level.
        for node in range(size):
            value[node] = self.value[node] if node in self.value else value[(node - 1) // 2] if node else 0.0
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 2 - (x[rows, feature[node]] <= at[node])
        return value[node]

    def score(self, row: list[float]) -> float:
        node = 0
        while node in self.split:
            f, at = self.split[node]
            node = 2 * node + (1 if row[f] <= at else 2)
        return self.value[node]


@dataclass
class Judge:
    trees: list[Tree]
    slope: float
    shift: float
    thresholds: list[float]

    def raw(self, row: list[float]) -> float:
        return RATE * sum(t.score(row) for t in self.trees)

    def probability(self, row: list[float]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(row) + self.shift, -30, 30)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """``probability`` of every row of a matrix."""
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree.scores(x)
        return 1 / (1 + np.exp(-np.clip(self.slope * (RATE * total) + self.shift, -30, 30)))

    def selects(self, row: list[float]) -> bool:
        return self.probability(row) >= self.thresholds[int(row[0])]


def fit(rows: list[list[float]], labels: list[int]) -> Judge:
    """Boosted trees on four fifths of the rows, calibrated on the others."""
    x, y = np.array(rows, float), np.array(labels, float)
    held = np.arange(len(y)) % 5 == 0
    xt, yt, z = x[~held], y[~held], np.zeros((~held).sum())
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = Tree(xt, p - yt, np.maximum(p * (1 - p), 1e-6), DEPTH)
        trees.append(tree)
        z += RATE * np.array([tree.score(r) for r in xt])
    judge = Judge(trees, 1.0, 0.0, [0.5] * len(KINDS))
    z, yh = np.array([judge.raw(r) for r in x[held]]), y[held]
    # Platt scaling by Newton steps, towards labels that are not quite sure.
    soft = np.where(yh == 1, (yh.sum() + 1) / (yh.sum() + 2), 1 / ((1 - yh).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, [((p - soft) * z).sum(), (p - soft).sum()])
        a, b = a - step[0], b - step[1]
    judge.slope, judge.shift = float(a), float(b)
    p = np.array([judge.probability(r) for r in x[held]])
    for k in range(len(KINDS)):
        own = x[held][:, 0] == k
        for t in np.linspace(0.5, 0.99, 50):
            chosen = own & (p >= t)
            judge.thresholds[k] = float(t)
            if not chosen.any() or yh[chosen].mean() >= PRECISION:
                break
    return judge


def _number(r: random.Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _number(r, r.choice((14, 14, 13)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _again(r: random.Random, body: str, kind: str) -> str:
    """Another number written like ``body``."""
    new = body[:1] + "".join(_number(r, 1) if "0" <= c <= "9" else c for c in body[1:])
    return next((new[:-1] + c for c in "0123456789" if luhn(_digits(new[:-1] + c))), new) if kind == "card" else new


def made_examples(count: int, seed: int = SEED) -> tuple[list[list[float]], list[int]]:
    """Candidates made by rule, with their labels."""
    r, rows, labels = random.Random(seed), [], []
    word = lambda: "".join(r.choices("abdefghiklmnoprstuw", k=r.randint(2, 8)))
    while len(rows) < count:
        good, kind = r.random() < 0.5, r.choice(KINDS)
        hint = ""
        if kind == "email":
            at, dot = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), ("{at}", "{dot}"), (" @ ", "."), ("@", " dot ")))
            body = f"{word()}{r.choice(('', '.', '_'))}{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'de', 'net', 'example'))}"
            if not good:
                body = r.choice((f"{word()} at {word()} dot {word()}", f"{word()} @ {word()}.{_number(r, 2)}", f"{r.randint(1, 99)} at {word()} dot {word()}"))
            hint = r.choice(("e-mail: ", "contact ", "write ")) if good and r.random() < 0.4 else ""
        elif kind == "ip":
            quad = [str(r.randrange(256)) for _ in range(4)]
            body = r.choice(("[.]".join(quad), "(.)".join(quad), ":".join("%x" % r.randrange(65536) for _ in range(8))))
            if not good:
                body = r.choice((".".join([*quad[:3], str(r.randint(256, 999))]), ":".join("%02d" % r.randrange(60) for _ in range(4)), "[.]".join([str(r.randint(256, 999)), *quad[1:]])))
            hint = r.choice(("ip ", "host: ", "server ")) if good and r.random() < 0.3 else r.choice(("version ", "build ")) if not good and r.random() < 0.5 else ""
        elif kind == "card":
            c, sep = _card(r), r.choice((".", "  ", "/", "_", " - "))
            body = sep.join((c[:4], c[4:8], c[8:12], c[12:]))
            if not good:
                body = r.choice((_number(r, r.randint(12, 19)), sep.join(_number(r, 4) for _ in range(r.randint(3, 4))), f"{_number(r, 3)}-{_number(r, 10)}", f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-1{r.randrange(9)} 1{r.randrange(9)}.{r.randint(10, 59)}.{r.randint(10, 59)}"))
            hint = r.choice(("card: ", "visa ", "credit card no. ")) if good and r.random() < 0.5 else r.choice(("order ", "isbn ", "id ", "invoice ")) if not good and r.random() < 0.5 else ""
        else:
            a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
            body = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{r.randint(1, 99)} {a} {b}{c}", f"0{a} {b}{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"))
            hint = r.choice(("phone: ", "tel. ", "call ", "mobile ")) if r.random() < 0.6 or body[0] not in "(0" else ""
            if not good:
                body = r.choice((f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1990, 2030)}", _number(r, r.randint(7, 15)), f"{_number(r, 1)} {_number(r, 3)} {_number(r, 3)} {_number(r, 3)}", f"{_number(r, 4)} {_number(r, 4)}", f"{_number(r, 3)}.{_number(r, 3)}.{_number(r, 2)}"))
                hint = r.choice(("total ", "version ", "order no. ", "", "", "", "page ", "€ "))
        before, after = f"{word()} {word()} ", f" {word()}"
        if kind in ("card", "phone") and r.random() < 0.5:
            # Numbers side by side: each is one, what reaches from one into another is none.
            twin = _again(r, body, kind) if good else body
            other = r.choice((twin, twin, f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 12)}/{r.randint(24, 32)} {_number(r, 3)}"))
            if r.random() < 0.5:
                before += other + " "
            elif other == twin and r.random() < 0.5:
                before, hint = before + hint + other + " ", ""
            else:
                after = f" {other}{after}"
        text = f"{before}{hint}{body}{after}"
        start = len(before) + len(hint)
        span = (kind, start, start + len(body))
        across = [c for c in candidates(text) if c[0] == kind and c != span and c[1] < span[2] and span[1] < c[2]] if kind in ("card", "phone") else []
        if across and r.random() < 0.4:
            span, good = r.choice(across), False
        rows.append(features(text, span))
        labels.append(int(good))
    return rows, labels


def _apart(spans: Iterable[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Those of ``spans`` that overlap none of ``others``."""
    taken = set().union(*(range(s, e) for _, s, e in others))
    return (x for x in spans if taken.isdisjoint(range(x[1], x[2])))


def _closest(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> set[tuple[str, int, int]]:
    """Of the spans that overlap a base span of their kind, that closest to its ends."""
    out = set()
    for k in KINDS:
        own = sorted((x for x in spans if x[0] == k), key=lambda x: x[1])
        starts, longest = [x[1] for x in own], max((x[2] - x[1] for x in own), default=0)
        for _, s, e in (b for b in base if b[0] == k):
            near = [x for x in own[bisect_left(starts, s - longest) : bisect_left(starts, e)] if x[2] > s]
            if near:
                out.add(min(near, key=lambda x: (abs(x[1] - s) + abs(x[2] - e), x)))
    return out


def training_rows(docs: DataFrame, key: str, text: str) -> tuple[list[list[float]], list[int]]:
    """Candidates of a bounded sample of documents: base spans of their kind against all else.

    The documents are those whose ids hash smallest; of their candidates, in the order of
    a hash, at most ``SAMPLE_ROWS`` reach the driver, as features only.
    """
    ids = docs.select(F.col(key).alias("key")).where("key is not null").orderBy(F.xxhash64("key"), "key").limit(SAMPLE_DOCS)
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(ids.distinct(), "key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            rows, labels = [], []
            for body in batch.column(0).to_pylist():
                base, found_spans = base_spans(body or ""), candidates(body or "")
                told = _closest(found_spans, base)
                rows += [features(body, span) for span in found_spans]
                labels += [int(span in told) for span in found_spans]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["x", "y"])

    sample = found.mapInArrow(run, "x array<double>, y int").orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE_ROWS).collect()
    return [list(r["x"]) for r in sample], [r["y"] for r in sample]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Judge:
    made, labels = made_examples(MADE_ROWS)
    more, also = training_rows(docs, key, text)
    return fit(made + more, labels + also)


def personal_data(docs: DataFrame, judge: Judge | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, spans`` of every row: arrays of ``kind:start:end`` in text order.

    Starts and ends are code points, ends exclusive; ``spans`` holds all of ``base``. A
    span is added where the judge selects it and nothing chosen overlaps it, the likeliest
    first. Null and empty texts have none; rows are independent; other columns are not read.
    """
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(judge or train(docs, key, text))
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            base, spans = [], []
            for body in batch.column(1).to_pylist():
                kept = sorted(base_spans(body or ""), key=order)
                base.append([f"{k}:{s}:{e}" for k, s, e in kept])
                spans.append([f"{k}:{s}:{e}" for k, s, e in sorted(kept + added(shared.value, body or "", kept), key=order)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.string()))], names=["key", "base", "spans"]
            )

    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(run, f"key {kind}, base array<string>, spans array<string>").withColumnRenamed("key", key)


def _before(text: str, start: int) -> list[float]:
    """What the place a number starts at tells: hints by kind, wrong words, and neighbours."""
    before = text[max(0, start - 24) : start]
    joined = _joined(_JOINED_BEFORE.search(before))
    if joined:
        before = text[max(0, start - 64) : start].rstrip("0123456789 ./-–_()")
    hints = [float(bool(_HINTS[kind].search(before))) for kind in KINDS] if before else [0.0] * len(KINDS)
    wrong = float(bool(before and _WRONG.search(before)))
    return [*hints, wrong, joined, float(start > 0 and text[start - 1].isalnum())]


def number_tables(text: str, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, features) of the candidates of ``_numbers``, for blocks of digit groups.

    The features are those of ``features``, in the same order. What depends on a group, a
    gap or a place in the text is found once; a candidate is a pair of groups.
    """
    found = [m.span() for m in _GROUP.finditer(text)]
    if not found:
        return
    begins, ends = np.array(found).T
    n, most = len(found), CARD_DIGITS[-1]
    sizes = ends - begins
    before = np.concatenate([[0], np.cumsum(sizes)])  # digits before each group
    digits = np.frombuffer("".join(text[a:b] for a, b in found).encode(), np.uint8).astype(np.int64) - 48
    doubled = np.where(digits > 4, 2 * digits - 9, 2 * digits)
    even = np.arange(len(digits)) % 2 == 0
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.where(even, digits, doubled), np.where(even, doubled, digits))]
    masks = np.bitwise_or.reduceat(1 << digits, before[:-1])
    names: dict[str, int] = {"(": 0}
    gap, run, start = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
    single = np.zeros(n, np.int64)  # 1 for a gap of one of " -./", 2 for one of these that is no space
    paren = np.zeros(n, bool)
    for i, (a, b) in enumerate(found):
        if i:
            between = text[found[i - 1][1] : a]
            joined = bool(_GAP.fullmatch(between))
            run[i] = run[i - 1] + (not joined)
            if joined:
                gap[i] = names.setdefault(between, len(names))
                single[i] = (1 if between == " " else 2) if between in (" ", "-", ".", "/") else 0
                paren[i] = "(" in between
        if a and text[a - 1] == "(" and not (a > 1 and _within(text[a - 2], "+")):
            start[i] = a - 1
        elif not (a and _within(text[a - 1], "+")):
            start[i] = a
    closed = np.array([not (b < len(text) and _within(text[b])) for _, b in found])
    lead = np.minimum(before[:-1] + 1, len(digits) - 1)
    first, second = digits[before[:-1]], digits[lead]
    year = (sizes >= 4) & ((first == 1) & (second == 9) | (first == 2) & (second == 0))
    short = sizes <= 2
    later = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), x.dtype)])
    dated = (year & (sizes == 4) & (later(single, 1) > 0) & later(short, 1) & (later(single, 2) > 0)) | (
        short & (later(single, 1) == 2) & later(short, 1) & (later(single, 2) == 2) & later(year, 2)
    )
    dated &= start == begins
    contexts: dict[int, list[float]] = {}
    afters: dict[int, tuple[float, float]] = {}

    for low in range(0, n, block):
        j = np.arange(low, min(n, low + block))
        mask, largest, least = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64), np.full(len(j), 1 << 40)
        distinct, bracket, opened = np.zeros(len(j), np.int64), np.zeros(len(j), bool), np.zeros(len(j), bool)
        parts = []
        for back in range(min(most, low + len(j))):
            i = j - back
            at = np.maximum(i, 0)
            alive = (i >= 0) & (run[at] == run[j])
            mask |= masks[at]
            largest, least = np.maximum(largest, sizes[at]), np.minimum(least, sizes[at])
            if back:  # the gap behind group i joins the number
                new, own = gap[np.minimum(at + 1, n - 1)], np.ones(len(j), bool)
                for k in range(1, back):
                    own &= gap[np.minimum(at + 1 + k, n - 1)] != new
                distinct = distinct + own
                bracket = bracket | paren[np.minimum(at + 1, n - 1)]
                opened = opened | (new == 0)
            count = before[j + 1] - before[at]
            good = alive & closed[j] & (start[at] >= 0) & (count <= most)
            for kind, wanted in ((2, CARD_DIGITS), (3, PHONE_DIGITS)):
                rows = np.flatnonzero(good & (count >= wanted[0]) & (count <= wanted[-1]))
                if not len(rows):
                    continue
                gi, gj, nd = at[rows], j[rows], count[rows]
                begin, end = start[gi], ends[gj]
                led = begin < begins[gi]
                odd = (before[gj + 1] - 1) % 2
                luhn_sum = np.where(odd == 0, sums[0][before[gj + 1]] - sums[0][before[gi]], sums[1][before[gj + 1]] - sums[1][before[gi]])
                for g in np.unique(gi).tolist():
                    if g not in contexts:
                        contexts[g] = _before(text, int(start[g]))
                for g in np.unique(gj).tolist():
                    if g not in afters:
                        e = int(ends[g])
                        afters[g] = (float(e < len(text) and text[e].isalnum()), _joined(_JOINED_AFTER.match(text, e)))
                told = np.array([contexts[g] for g in gi.tolist()])
                after = np.array([afters[g] for g in gj.tolist()])
                zero, length = np.zeros(len(rows)), end - begin
                values = np.bitwise_count(mask[rows])
                x = np.stack(
                    [
                        zero + kind, length, nd, nd / length, zero + back + 1, largest[rows], least[rows],
                        distinct[rows] + (led & ~opened[rows]), luhn_sum % 10 == 0, (first[gi] >= 3) & (first[gi] <= 6), led | bracket[rows],
                        zero, zero, zero, zero, zero, zero, zero,
                        (first[gi] == 0) & (second[gi] == 0), first[gi] == 0, values <= 3,
                        told[:, kind], told[:, [k for k in range(4) if k != kind]].any(1), told[:, 4], dated[gi] & (back >= 2),
                        told[:, 6], after[:, 0], sizes[gi], sizes[gj], told[:, 5], after[:, 1],
                    ],
                    axis=1,
                ).astype(float)
                parts.append((begin, end, x))
        contexts = {g: c for g, c in contexts.items() if g > low + len(j) - 2 * most}
        afters.clear()
        if parts:
            yield tuple(np.concatenate(column) for column in zip(*parts))


def added(judge: Judge, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates apart from base spans that the judge selects, without overlaps."""
    out: list[tuple[str, int, int]] = []
    rows = ((span, features(text, span)) for span in _apart(_written(text), base))
    scored = [(-judge.probability(x), span) for span, x in rows if judge.selects(x)]
    covered = np.zeros(len(text) + 1, np.int64)
    for _, s, e in base:
        covered[s:e] = 1
    covered = np.concatenate([[0], np.cumsum(covered)])
    limits = np.array(judge.thresholds)
    for begin, end, x in number_tables(text):
        apart = covered[end] == covered[begin]
        begin, end, x = begin[apart], end[apart], x[apart]
        p = judge.probabilities(x)
        for k in np.flatnonzero(p >= limits[x[:, 0].astype(int)]).tolist():
            scored.append((-float(p[k]), (KINDS[int(x[k, 0])], int(begin[k]), int(end[k]))))
    scored.sort(key=lambda v: (v[0], v[1][1], v[1]))
    # A place is taken by at most one span; places are characters of candidates only.
    taken: set[int] = set()
    for _, span in scored:
        if taken.isdisjoint(range(span[1], span[2])):
            taken.update(range(span[1], span[2]))
            out.append(span)
    return out


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of base spans, and all spans."""
    found = personal_data(table(prepared(spark), sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.startswith(f"{kind}:"))).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )
