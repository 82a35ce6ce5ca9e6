"""Personal data by candidates and gradient boosting.

Exact patterns with checks give the base spans, which always stay. Generators of high recall then
propose further spans, which may overlap: addresses with their signs spelled out, numbers with
other separators, national phone numbers. Boosted trees score each proposal by its format and its
context, and a threshold per kind, calibrated on held-out proposals, selects those that are
redacted, too. No table of labelled spans is needed: the trees learn from spans of known kind and
look-alikes that are written into contexts cut from a bounded sample of the texts.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.storage import sample_rows

KINDS = ("email", "ip", "card", "phone")
# Texts that contexts are cut from, contexts of a text, and characters on each side of a context.
SAMPLE_TEXTS = 500
CONTEXTS_PER_TEXT = 12
CONTEXT_CHARS = 60
# Spans written into contexts to learn from.
PASSAGES = 6000
# Calibrated probability from which a proposal is redacted.
ACCEPT = 0.95
TREES = 60
DEPTH = 3
RATE = 0.25
BINS = 24
LEAF_PENALTY = 1.0
SEED = 12

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+", re.ASCII)
# The first digit of a run only, so that a long run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", re.ASCII)
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+", re.ASCII)
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]", re.ASCII)
_NOT_DIGIT = re.compile(r"[^0-9]+", re.ASCII)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The exact patterns, leftmost and without overlap for each kind, in order; a match that
    fails its check is dropped without another try. Linear in the text."""
    found: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        # The sign is no part of a local name, so a match begins with the whole run before it.
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


# ---- generators ----

_AT = re.compile(r"[ ]?[\[({<] ?at ?[\])}>][ ]?|[ ]?＠[ ]?| at | @ ", re.IGNORECASE)
_DOT = r"(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot | \. |\.)"
_SPELLED_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE | re.ASCII)
_DOT_SIGN = re.compile(_DOT, re.IGNORECASE)
_GOES_ON = re.compile(rf"{_DOT}[A-Za-z0-9]", re.IGNORECASE | re.ASCII)
_SPELLED_IP = re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])", re.IGNORECASE | re.ASCII)
_COLON_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", re.ASCII)
_REGION = re.compile(r"[0-9](?:[  ().\-‐-–/_]{0,3}[0-9])*+", re.ASCII)
_GROUP = re.compile(r"[0-9]+", re.ASCII)
_SPELLED_SIGNS = re.compile(r"[\[({<] ?(?:dot|\.) ?[\])}>]", re.IGNORECASE)
# Groups of digits in one proposal, and labels of a spelled domain.
_MOST_GROUPS = 7
_MOST_LABELS = 4
_LOCAL_REACH = 64
_FEWEST_DIGITS, _MOST_DIGITS = 8, 19


def _is_free(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def proposals(text: str) -> Iterator[Span]:
    """Spans that could be personal data; they may overlap each other and the base spans."""
    for m in _AT.finditer(text):
        before = text[max(0, m.start() - _LOCAL_REACH):m.start()]
        start = m.start() - (len(before) - len(before.rstrip(_LOCAL)))
        domain = _SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            signs = [d.start() for d in _DOT_SIGN.finditer(text, m.end(), domain.end())][1:_MOST_LABELS]
            for end in {*signs, domain.end()}:
                yield "email", start, end
    if _SPELLED_SIGNS.search(text):
        for m in _SPELLED_IP.finditer(text):
            yield "ip", *m.span()
    if text.count(":") >= 3:
        for m in _COLON_IP.finditer(text):
            yield "ip", *m.span()
    for region in _REGION.finditer(text):
        if region.end() - region.start() < _FEWEST_DIGITS:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *region.span())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for a, end in groups[i:i + _MOST_GROUPS]:
                n += end - a
                if n > _MOST_DIGITS:
                    break
                if n < _FEWEST_DIGITS:
                    continue
                opened = text[start - 1:start] == "(" and ")" in text[start:end]
                plus = start - opened
                for begin in {start - opened, plus - (text[plus - 1:plus] == "+")}:
                    if not _is_free(text, begin, end):
                        continue
                    if n <= 15:
                        yield "phone", begin, end
                    if n >= 13 and begin == start:
                        yield "card", begin, end


# ---- features ----

# Words that name a kind of data before it, and words that name other numbers.
_CUES = {
    "email": "mail email e-mail contact kontakt correo courriel write reach adresse address",
    "ip": "ip host server node client peer address adresse proxy gateway router login",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment pay cc pan",
    "phone": "phone tel telephone telefon call cell mobile fax handy portable telefono ring whatsapp sms",
}
_OTHER = (
    "isbn issn version order no nr number id invoice page pages date total price sum token key hash serial part ref "
    "reference rechnung facture pedido article room chapter figure table score lat lon build code sku uuid mac"
)
_CUE_WORDS = {kind: frozenset(words.split()) for kind, words in _CUES.items()}
_OTHER_WORDS = frozenset(_OTHER.split())
_CONTEXT_WORD = re.compile(r"[^\W\d_]+")
_CONTEXT_REACH = 40
_MONEY = "$€£¥%"
_COMMON_ENDS = frozenset("com org net edu gov io info biz de fr es uk it nl ch at eu us co".split())

FEATURES = (
    "digits", "letters", "length", "groups", "longest_group", "shortest_group", "first_group", "last_group", "equal_groups",
    "signs", "kinds_of_sign", "dash", "point", "blank", "slash", "underscore", "plus", "open_bracket", "zero_zero", "luhn",
    "first_digit", "distinct_digits", "parts_fit", "spelled_at", "spelled_dot", "end_letters", "common_end", "local_letters",
    "colons", "double_colon", "quote_before", "equals_before", "colon_before", "money", "number_before", "number_after",
    "own_cue", "other_cue", "foreign_cue", "date_like", "book_like", "sentence_end",
    "goes_on",
)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal as numbers."""
    kind, start, end = span
    shown = text[start:end]
    groups = _GROUP.findall(shown)
    digits = "".join(groups)
    lengths = [len(g) for g in groups] or [0]
    signs = [c for c in shown if not c.isalnum()]
    before, after = text[max(0, start - _CONTEXT_REACH):start], text[end:end + 8]
    close, follow = before.rstrip(" ("), after.lstrip(" )")
    words = {w.lower() for w in _CONTEXT_WORD.findall(before)}
    at = _AT.search(shown) if kind == "email" else None
    last = _DOT_SIGN.split(shown[at.end():])[-1] if at else ""
    years = lengths[:1] == [4] and digits[:2] in ("19", "20") or lengths[-1:] == [4] and groups[-1][:2] in ("19", "20")
    return [
        len(digits), sum(c.isalpha() for c in shown), len(shown), len(groups), max(lengths), min(lengths), lengths[0],
        lengths[-1], len(set(lengths)) == 1, len(signs), len(set(signs)), shown.count("-"), shown.count("."),
        shown.count(" "), shown.count("/"), shown.count("_"), shown[:1] == "+", "(" in shown[:2], digits[:2] == "00",
        len(digits) >= 13 and luhn(digits), int(digits[0]) if digits else -1, len(set(digits)),
        all(len(g) <= 3 and int(g) <= 255 for g in groups), at is not None and "at" in at.group().lower(),
        len(re.findall("dot", shown, re.IGNORECASE)) + sum(shown.count(b) for b in "[({<"), len(last) if last.isalpha() else 0,
        last.lower() in _COMMON_ENDS, sum(c.isalpha() for c in shown[:at.start()]) if at else 0, shown.count(":"), "::" in shown,
        close[-1:] in "\"'`" if close else 0, close[-1:] == "=", close[-1:] == ":", close[-1:] in _MONEY and close != "" or follow[:1] in _MONEY and follow != "",
        close[-1:].isdigit() or close[-2:-1].isdigit() and close[-1:] in ".-/,:", follow[:1].isdigit() or follow[1:2].isdigit() and follow[:1] in ".-/,:",
        bool(words & _CUE_WORDS[kind]), bool(words & _OTHER_WORDS), any(words & w for k, w in _CUE_WORDS.items() if k != kind),
        bool(years) and len(groups) >= 3, digits[:3] in ("978", "979"), follow[:1] in ".,;!?\n" if follow else 1,
        _GOES_ON.match(text, end) is not None,
    ]


# ---- boosted trees ----


@dataclass
class Trees:
    """Boosted trees of one depth: a cut per inner node, a value per leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[each, feature[node]] > cut[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return total


def boost(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Trees for the logistic loss, grown level by level on binned features."""
    inner = 2 ** DEPTH - 1
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, rows.T)], axis=1)
    total, made = np.full(len(labels), base), []
    for _ in range(TREES if 0 < labels.sum() < len(labels) else 0):
        p = 1 / (1 + np.exp(-total))
        grad, hess = labels - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(DEPTH):
            first, count = 2 ** level - 1, 2 ** level
            gains = np.zeros(count)
            for k, edge in enumerate(edges):
                if not len(edge):
                    continue
                size = len(edge) + 1
                place = (node - first) * size + binned[:, k]
                g = np.bincount(place, grad, count * size).reshape(count, size)
                h = np.bincount(place, hess, count * size).reshape(count, size)
                gl, hl = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
                gt, ht = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
                gain = gl ** 2 / (hl + LEAF_PENALTY) + (gt - gl) ** 2 / (ht - hl + LEAF_PENALTY) - gt ** 2 / (ht + LEAF_PENALTY)
                best = gain.argmax(axis=1)
                value = gain[np.arange(count), best]
                better = value > gains + 1e-9
                gains[better] = value[better]
                feature[first:first + count][better] = k
                cut[first:first + count][better] = edge[best[better]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > cut[node])
        at = node - inner
        leaf = RATE * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + LEAF_PENALTY)
        total += leaf[at]
        made.append((feature, cut, leaf))
    shape = [(inner, np.int64), (inner, float), (inner + 1, float)]
    return Trees(base, *[np.array([m[k] for m in made], dtype=t).reshape(-1, n) for k, (n, t) in enumerate(shape)])


@dataclass
class Calibration:
    """Rising steps from raw scores to shares of true spans on held-out proposals."""

    starts: list[float] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)

    def share(self, score: float) -> float:
        at = bisect_right(self.starts, score) - 1
        return self.shares[at] if at >= 0 else 0.0


def calibrate(scores: np.ndarray, labels: np.ndarray) -> Calibration:
    """Isotonic steps; a step counts one false span more than it holds, so small ones prove little.

    A step begins halfway between its own scores and those of the step below.
    """
    steps: list[list[float]] = []
    for score in np.unique(scores):
        mine = labels[scores == score]
        steps.append([float(score), float(score), float(mine.sum()), len(mine)])
        while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
            _, last, hits, n = steps.pop()
            steps[-1][1:] = [last, steps[-1][2] + hits, steps[-1][3] + n]
    starts = [(below[1] + step[0]) / 2 for below, step in zip(steps, steps[1:])]
    return Calibration([float("-inf"), *starts] if steps else [], [hits / (n + 1) for *_, hits, n in steps])


@dataclass
class Model:
    trees: dict[str, Trees]
    steps: dict[str, Calibration]

    def shares(self, kind: str, rows: np.ndarray) -> list[float]:
        """Calibrated probability of proposals of one kind; 0 for a kind that was not learned."""
        if kind not in self.trees:
            return [0.0] * len(rows)
        return [self.steps[kind].share(s) for s in self.trees[kind].raw(rows).tolist()]


# ---- passages to learn from ----


def _digits(rng: random.Random, n: int, first: str = "") -> str:
    return first + "".join(rng.choice("0123456789") for _ in range(n - len(first)))


def _parts(rng: random.Random) -> list[str]:
    """Four parts of an address, of one to three digits alike often."""
    return [str(rng.randint(*rng.choice([(0, 9), (10, 99), (100, 255)]))) for _ in range(4)]


def _card(rng: random.Random, n: int, valid: bool) -> str:
    digits = _digits(rng, n - 1, rng.choice(["4", "5", "37", "6011"]))
    last = next(d for d in "0123456789" if luhn(digits + d))
    return digits + (last if valid else str((int(last) + rng.randint(1, 9)) % 10))


def _split(digits: str, sizes: list[int], sign: str) -> str:
    ends = [sum(sizes[:k + 1]) for k in range(len(sizes))]
    return sign.join(digits[e - s:e] for s, e in zip(sizes, ends))


def _true_span(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """Kind, cue before and text of a span in a form beyond the base patterns."""
    kind = rng.choice(KINDS)
    if kind == "email":
        name = rng.choice(words).lower() + rng.choice(["", ".", "_", "-"]) + rng.choice(["", rng.choice(words), str(rng.randint(1, 99))])
        site, end = rng.choice(words).lower() + rng.choice(["", "mail", str(rng.randint(1, 9))]), rng.choice(sorted(_COMMON_ENDS))
        at = rng.choice([" [at] ", "[at]", " (at) ", "(at)", " at ", " AT ", "＠", " @ ", "{at}", "<at>"])
        dot = rng.choice([" dot ", " DOT ", "[dot]", " [dot] ", "(dot)", ".", "[.]"]) if at.strip().lower() != "at" else rng.choice([" dot ", " DOT ", "[dot]", "."])
        shown = name + at + dot.join([site, *([rng.choice(words).lower()] if rng.random() < 0.3 else []), end])
    elif kind == "ip":
        if rng.random() < 0.3:
            parts = [f"{rng.randint(0, 65535):x}" for _ in range(8)]
            shown = ":".join(parts) if rng.random() < 0.5 else ":".join(parts[:3]) + "::" + ":".join(parts[:2])
        else:
            dot = rng.choice(["[.]", "(.)", "[dot]", "(dot)", " [.] "])
            shown = dot.join(_parts(rng))
    elif kind == "card":
        n, sizes = rng.choice([(16, [4, 4, 4, 4]), (16, [4, 4, 4, 4]), (15, [4, 6, 5]), (14, [4, 6, 4])])
        sign = rng.choice([".", "/", "_", "  ", " ", "–"]) if n == 16 else rng.choice([" ", "-", ".", ""])
        shown = _split(_card(rng, n, True), sizes, sign)
    else:
        form = rng.randint(0, 5)
        area, middle, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        sign = rng.choice(["-", ".", " "])
        shown = [
            f"({area}) {middle}-{last}", f"{area}{sign}{middle}{sign}{last}", f"00{rng.randint(1, 99)} {area} {middle} {last}",
            f"0{area} {_digits(rng, 7)}", f"+{rng.randint(1, 99)}/{area}/{middle}{last}", f"+{rng.randint(1, 99)}–{area}–{middle}–{last}",
        ][form]
        # Groups of digits without brackets or a code of a country need a word that tells.
        if form in (1, 3):
            return kind, rng.choice(sorted(_CUE_WORDS[kind])) + rng.choice([": ", " "]), shown
    told = rng.random()
    named = rng.choice(sorted(_CUE_WORDS[kind]) if told < 0.5 else words) + rng.choice([": ", " ", " is ", " = ", ' "', " ("])
    cue = named if told < 0.8 else ""
    return kind, cue, shown


def _look_alike(rng: random.Random, words: list[str]) -> str:
    """Text that generators propose and that is no personal data."""
    year, month, day = rng.randint(1950, 2039), rng.randint(1, 12), rng.randint(1, 28)
    cue = rng.choice(sorted(_OTHER_WORDS)) + rng.choice([" ", ": ", " = "])
    sign = rng.choice(["-", ".", " ", "/", "_", "", "  ", "–"])
    a, b, c = (rng.choice(words) for _ in range(3))
    wrong = _card(rng, rng.choice([14, 15, 16, 16, 16]), False)
    return rng.choice([
        f"{year}-{month:02}-{day:02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
        f"{year}{month:02}{day:02}", f"{year}{month:02}{day:02}-{_digits(rng, 6)}", f"{day:02}.{month:02}.{year} - {day:02}.{month:02}.{year + 1}",
        wrong, _split(wrong, [4, 4, 4, len(wrong) - 12], sign), cue + _split(wrong, [4, 4, 4, len(wrong) - 12], sign),
        cue + _digits(rng, rng.randint(8, 19)), _digits(rng, rng.randint(8, 19)), cue + _split(_digits(rng, 10), [3, 3, 4], sign),
        "978-" + _split(_digits(rng, 10), [1, 2, 6, 1], "-"), f"isbn 979 {_digits(rng, 10)}", f"{rng.randint(1, 999)}.{_digits(rng, 12)}",
        f"{rng.choice('$€')}{_split(_digits(rng, 12), [3, 3, 3, 3], '.')}", " ".join(str(rng.randint(1, 999)) for _ in range(rng.randint(4, 12))),
        "-".join(_digits(rng, k) for k in (8, 4, 4, 12)), f'token = "{_digits(rng, 9)}"', f"{_split(_digits(rng, 9), [3, 3, 3], sign)} %",
        f"{a} at {b}.{c}", f"{a} at {b} . {c}", f"{a} @ {rng.randint(1, 9)}.{rng.randint(10, 99)}", f"{a} at {rng.randint(1, 12)}.{rng.randint(10, 59)}",
        f"{a} at {b}. {c.title()}", f"the {a} (at {b}) dot {c}", f"{a} (at) {b}", ":".join(f"{rng.randint(0, 255):02x}" for _ in range(6)),
        ":".join(str(rng.randint(10, 59)) for _ in range(4)), "[.]".join([*_parts(rng)[:3], str(rng.randint(256, 999))]), f"{a}::{b}::{c}",
    ])


def training_rows(contexts: list[tuple[str, str]], passages: int = PASSAGES) -> list[tuple[str, int, int, list[float]]]:
    """Kind, passage number, label and features of every proposal in the written passages."""
    rng = random.Random(SEED)
    contexts = contexts or [("", "")]
    words = sorted({w for c in contexts for w in re.findall(r"[A-Za-z]{2,12}", " ".join(c))}) or ["one", "two", "three"]
    out = []
    for number in range(passages):
        left, right = rng.choice(contexts)
        left, right = left + " " if left else "", " " + right if right else ""
        true = None
        if rng.random() < 0.45:
            kind, cue, shown = _true_span(rng, words)
            start = len(left) + len(cue)
            true, middle = (kind, start, start + len(shown)), cue + shown
        else:
            middle = _look_alike(rng, words)
        text = left + middle + rng.choice(["", "", ".", ","]) + right
        for span in further(text, base_spans(text)):
            out.append((span[0], number, int(span == true), features(text, span)))
    return out


def learn(rows: list[tuple[str, int, int, list[float]]]) -> Model:
    """Trees per kind from four of five passages, calibrated on the fifth."""
    trees, steps = {}, {}
    for kind in KINDS:
        mine = [r for r in rows if r[0] == kind]
        if not mine:
            continue
        held = np.array([r[1] % 5 == 0 for r in mine])
        labels = np.array([r[2] for r in mine], dtype=float)
        made = np.array([r[3] for r in mine], dtype=float)
        if held.all() or not held.any():
            continue
        trees[kind] = boost(made[~held], labels[~held])
        steps[kind] = calibrate(trees[kind].raw(made[held]), labels[held])
    return Model(trees, steps)


def contexts_of(text: str, n: int = CONTEXTS_PER_TEXT) -> list[tuple[str, str]]:
    """Text to the left and right of ``n`` evenly spaced places of a text, cut between words."""
    found = []
    for k in range(1, n + 1):
        at = text.find(" ", len(text) * k // (n + 1))
        if at > 0:
            left, right = text[max(0, at - CONTEXT_CHARS):at], text[at + 1:at + 1 + CONTEXT_CHARS]
            found.append((left[left.find(" ") + 1:], right[:right.rfind(" ") + 1].rstrip()))
    return found


def train(docs: DataFrame, n: int = SAMPLE_TEXTS, passages: int = PASSAGES) -> Model:
    """Learn with contexts from at most ``n`` texts of ``docs(doc_id, text)``, chosen by hash.

    Without texts the spans are learned without context.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [contexts_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[list(c) for c in f] for f in found], pa.list_(pa.list_(pa.string())))],
                ["doc_id", "contexts"],
            )

    picked = sample_rows(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "doc_id", n)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        F.col("doc_id").cast("string"), "text"
    ).mapInArrow(cut, "doc_id string, contexts array<array<string>>").groupBy("doc_id").agg(F.min("contexts").alias("c"))
    rows = found.orderBy("doc_id").collect()
    return learn(training_rows([tuple(c) for r in rows for c in r["c"]], passages))


# ---- finding ----


def further(text: str, base: list[Span]) -> list[Span]:
    """The distinct proposals that touch no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach, ends = 0, []
    for _, e in taken:
        reach = max(reach, e)
        ends.append(reach)

    def is_clear(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or ends[k - 1] <= start

    return sorted({s for s in proposals(text) if is_clear(s[1], s[2])})


def added_spans(text: str, base: list[Span], model: Model, accept: float = ACCEPT) -> list[tuple[Span, float]]:
    """Accepted proposals with their probability, the most probable and longest first where they overlap."""
    likely: list[tuple[float, int, Span]] = []
    spans = further(text, base)
    for kind in KINDS:
        mine = [s for s in spans if s[0] == kind]
        for at in range(0, len(mine), 4096):
            part = mine[at:at + 4096]
            shares = model.shares(kind, np.array([features(text, s) for s in part], dtype=float))
            likely += [(-p, s[1] - s[2], s) for p, s in zip(shares, part) if p >= accept]
    chosen: list[tuple[int, int]] = []
    out = []
    for p, _, span in sorted(likely, key=lambda x: (x[0], x[1], x[2][1], KINDS.index(x[2][0]))):
        k = bisect_left(chosen, (span[1], span[2]))
        if (k == 0 or chosen[k - 1][1] <= span[1]) and (k == len(chosen) or span[2] <= chosen[k][0]):
            chosen.insert(k, (span[1], span[2]))
            out.append((span, -p))
    return out


def spans_of(text: str, model: Model, accept: float = ACCEPT) -> list[dict]:
    """All spans of a text, by kind and start."""
    base = base_spans(text)
    rows = [(KINDS.index(s[0]), s[1], s[2], True, 1.0) for s in base]
    rows += [(KINDS.index(s[0]), s[1], s[2], False, p) for s, p in added_spans(text, base, model, accept)]
    return [
        {"kind": KINDS[k], "start": start, "end": end, "base": is_base, "share": p}
        for k, start, end, is_base, p in sorted(rows)
    ]


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,share:double>>"
_SPAN_TYPE = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("share", pa.float64()),
]))


def find(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, spans)`` of every row of ``docs(doc_id, text)``, over whole texts.

    A span has its ``kind``, ``start`` and ``end`` in code points, whether it is a ``base`` one, and
    its probability. NULL and empty texts have none. Repeated rows and NULL ids keep a row each; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t or "", model, accept) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {_SPANS}")


def redacted(text: str, spans: list[dict]) -> str:
    """A text with ``[KIND]`` in place of its spans; spans that overlap become one."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            out += [text[at:span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with the personal data of column ``text`` replaced; NULL texts and all other columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, spans_of(t, model, accept)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base spans per kind, their digest, and all spans as one string."""
    base = F.filter("spans", lambda s: s["base"])

    def named(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
