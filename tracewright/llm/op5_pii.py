"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

The field scores candidate segments by features of the whole span (shape, digit count, checksum, separators, neighbours) and of the label before it
(an entity's kind, or none), and dynamic programming over segments of bounded length picks boundaries and kinds of a stretch of text jointly. Weights are
the maximum-likelihood fit, by stochastic gradient over forward-backward marginals, to annotated sentences that a seeded generator writes (filler, entities
in many notations, and look-alikes such as versions, dates and numbers with a wrong checksum); TRAIN sentences is the documented bound.

A segment is admissible if it has LONGEST tokens at most, no line break, and is either a number (four digits or more, no letters, from a digit, plus sign or
bracket to a digit) or an address (letters or digits at both ends, an at-sign or the word at in any case, and a dot or the word dot after it). Tokens in no
admissible segment are outside in every segmentation, so stretches of overlapping segments are decoded one by one, with the result of the whole text.

Base spans stay; a segment of the field is added where it overlaps none of them.

Null text: as an empty one. Null doc_id: as any other. Repeated rows: each its own row. Very long texts: whole; time and memory grow with their length.
Ties: the earlier start, then the kind listed first. Extra columns, whatever their names: not read. Empty table: no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_columns, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Sentences that the weights are fitted to, passes over them, and the longest segment in tokens.
TRAIN, PASSES, LONGEST = 240, 6, 16

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MAY = re.compile(r"[@0-9]|[Aa][Tt]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end) of the base patterns, by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [(0, *m.span()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        found += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# --- the field ---


def features(tokens: list[str], i: int, j: int) -> list[str]:
    """Of tokens[i:j] as one span."""
    span = "".join(tokens[i:j])
    d = _digits(span)
    n = len(d)
    shape = re.sub(r"9+", "9", re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", span))))
    low = span.lower()
    before, after = tokens[i - 1] if i else "", tokens[j] if j < len(tokens) else ""
    kind = lambda t: "" if not t else "s" if t.isspace() else "9" if t[0].isdigit() else "a" if t[0].isalpha() else t[0]
    out = ["bias", f"n{min(n, 20)}", f"b{kind(before)}", f"a{kind(after)}", f"f{kind(tokens[i])}", f"l{kind(tokens[j - 1])}"]
    if len(shape) <= 24:
        out.append("s" + shape)
    at = span.count("@") + low.count(" at ") + low.count("(at)") + low.count("[at]")
    if at:
        dots = span.rpartition("@")[2].count(".") + low.count(" dot ") + low.count("[dot]") + low.count("(dot)")
        out += [f"@{min(at, 2)}", f"@d{min(dots, 3)}", f"@e{tokens[j - 1].isalpha() and 2 <= len(tokens[j - 1]) <= 12}", f"@sp{min(span.count(' '), 5)}"]
    if n and not re.search(r"[^\W\d_]", span):
        separators = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
        parts = re.findall(r"[0-9]+", span)
        out += [f"p{separators}", f"g{len(parts)}", f"gl{'-'.join(str(len(p)) for p in parts[:6])}", f"+{span[0] == '+'}{8 <= n <= 15}"]
        if n >= 12:
            out.append(f"luhn{luhn(d)}{16 <= n <= 19}")
        if len(parts) == 4 and span.count(".") == 3:
            out.append(f"quad{all(int(p) <= 255 for p in parts if len(p) < 9)}")
    return out


_OPEN = frozenset("0123456789+(")
_AT, _DOT = frozenset(("@", "at")), frozenset((".", "dot"))


def admissible(tokens: list[str]) -> list[tuple[int, int]]:
    """All admissible segments, by start, then end."""
    starts: set[int] = set()
    for i, t in enumerate(tokens):
        if t[0] in _OPEN:
            starts.add(i)
        elif t in _AT or t.lower() == "at":
            starts.update(range(max(0, i - LONGEST + 1), i))
    found = []
    for i in sorted(starts):
        t = tokens[i]
        number, address = t[0] in _OPEN, t[0].isalnum()
        digits, at, dot = 0, False, False
        for j in range(i, min(len(tokens), i + LONGEST)):
            x = tokens[j]
            if "\n" in x:
                break
            first = x[0]
            if first in "0123456789":
                digits += len(x)
                if number and digits >= 4 or address and dot:
                    found.append((i, j + 1))
            elif first.isalpha():
                number = False
                low = x.lower()
                if address and dot and low not in ("at", "dot"):
                    found.append((i, j + 1))
                at = at or (low == "at" and j > i)
                dot = dot or (at and low == "dot")
            elif x == "@":
                number, at = False, at or j > i
            elif x == ".":
                dot = dot or at
            if not (number or address):
                break
    return found


def segments(tokens: list[str]) -> dict[tuple[int, int], list[str]]:
    """Admissible segments and their features."""
    return {(i, j): features(tokens, i, j) for i, j in admissible(tokens)}


#: Label of a token outside entities; kinds are the labels before it. Feature that stands for the weights of label after label.
OUT = len(KINDS)
LABELS = range(OUT + 1)


def _score(weights: dict, names: list[str], kinds: int) -> list[float]:
    total = [0.0] * kinds
    for f in names:
        if w := weights.get(f):
            for k in range(kinds):
                total[k] += w[k]
    return total


def _after(weights: dict) -> list[list[float]]:
    """Weight of each label (column) after each (row); outside after outside is 0."""
    rows = [weights.get(f">{y}", [0.0] * OUT) for y in LABELS]
    ends = weights.get(">out", [0.0] * OUT)
    return [[*rows[y], ends[y] if y < OUT else 0.0] for y in LABELS]


def decode(tokens: list[str], weights: dict) -> list[tuple[int, int, int]]:
    """The best segmentation's entities, (first token, end, kind)."""
    spans = admissible(tokens)
    if not spans:
        return []
    return _decoded(tokens, 0, len(tokens), spans, weights, _after(weights))


def _decoded(tokens: list[str], low: int, high: int, spans: list[tuple[int, int]], weights: dict, after: list[list[float]]) -> list[tuple[int, int, int]]:
    """The best segmentation of tokens[low:high], what comes before being outside."""
    n = high - low
    ending: dict[int, list] = {}
    for i, j in spans:
        ending.setdefault(j - low, []).append((i - low, _score(weights, features(tokens, i, j), OUT)))
    worst = -1e31
    best = [[worst] * (OUT + 1) for _ in range(n + 1)]
    back: list[list] = [[None] * (OUT + 1) for _ in range(n + 1)]
    best[0][OUT] = 0.0
    for j in range(1, n + 1):
        now, before = best[j], best[j - 1]
        y = max(LABELS, key=lambda y: before[y] + after[y][OUT])
        now[OUT], back[j][OUT] = before[y] + after[y][OUT], (j - 1, y)
        for i, x in ending.get(j, ()):
            from_ = best[i]
            for k in range(OUT):
                y = max(LABELS, key=lambda y: from_[y] + after[y][k])
                value = from_[y] + after[y][k] + x[k]
                if value > now[k]:
                    now[k], back[j][k] = value, (i, y)
    out, j = [], n
    y = max(LABELS, key=lambda y: (best[n][y] + after[y][OUT], y))  # what follows is outside
    while j:
        i, z = back[j][y]
        if y < OUT:
            out.append((low + i, low + j, y))
        j, y = i, z
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e30 else a


def _gradient(tokens: list[str], gold: set[tuple[int, int, int]], found: dict, weights: dict, rate: float, decay: float) -> None:
    """One step towards the gold segmentation's likelihood: features observed less those expected under the field."""
    n, kinds, after = len(tokens), range(OUT), _after(weights)
    scored = {s: _score(weights, f, OUT) for s, f in found.items()}
    low = -1e31
    ahead, behind = ([[low] * (OUT + 1) for _ in range(n + 1)] for _ in range(2))
    ahead[0][OUT] = 0.0
    starts: dict[int, list] = {}
    for s in scored:
        starts.setdefault(s[0], []).append(s)
    for i in range(n):
        for y in LABELS:
            if (x := ahead[i][y]) > -1e30:
                ahead[i + 1][OUT] = _add(ahead[i + 1][OUT], x + after[y][OUT])
                for s in starts.get(i, ()):
                    for k in kinds:
                        ahead[s[1]][k] = _add(ahead[s[1]][k], x + after[y][k] + scored[s][k])
    for y in LABELS:
        behind[n][y] = after[y][OUT]
    for i in range(n - 1, -1, -1):
        for y in LABELS:
            total = after[y][OUT] + behind[i + 1][OUT]
            for s in starts.get(i, ()):
                for k in kinds:
                    total = _add(total, after[y][k] + scored[s][k] + behind[s[1]][k])
            behind[i][y] = total
    whole = low
    for y in LABELS:
        if ahead[n][y] > -1e30:
            whole = _add(whole, ahead[n][y] + behind[n][y])

    def move(name: str, k: int, step: float) -> None:
        if abs(step) > 1e-3:
            w = weights.setdefault(name, [0.0] * OUT)
            w[k] += rate * (step - decay * w[k])

    ends = {b: k for _, b, k in gold}
    inside = {x for a, b, _ in gold for x in range(a, b)}
    for i in range(n + 1):
        for y in LABELS:
            if (x := ahead[i][y]) < -1e30:
                continue
            before = ends.get(i, OUT) if i == 0 or i - 1 in inside or i in ends else OUT
            if y < OUT:  # label y, then outside (or the end)
                rest = behind[i + 1][OUT] if i < n else 0.0
                p = math.exp(min(0.0, x + after[y][OUT] + rest - whole))
                move(">out", y, (before == y and ends.get(i) == y and i not in {a for a, _, _ in gold}) - p)
            for s in starts.get(i, ()):
                for k in kinds:
                    p = math.exp(min(0.0, x + after[y][k] + scored[s][k] + behind[s[1]][k] - whole))
                    step = ((*s, k) in gold and before == y) - p
                    move(f">{y}", k, step)
                    if abs(step) > 1e-3:
                        for f in found[s]:
                            move(f, k, step)


def _sentence(rng: random.Random) -> tuple[list[str], set]:
    """Tokens and gold segments of a made-up sentence."""
    word = lambda: "".join(rng.choice(("an", "er", "re", "on", "th", "in", "ou", "la", "de", "ch", "mi")) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        while True:
            d = rng.choice("3456") + num(rng.choice((15, 15, 15, 18)))
            if luhn(d) is good:
                s = rng.choice(("", "", " ", "-"))
                return s.join(d[a : a + 4] for a in range(0, len(d), 4))

    def email() -> str:
        a, b, tld = rng.choice((word(), word() + "." + num(2), word() + "_" + word(), word() + num(2))), word() + rng.choice(("", num(1), "." + word())), rng.choice(("com", "org", "net", "de", "example.com"))
        return rng.choice((f"{a}@{b}.{tld}",) * 3 + (f"{a} at {b} dot {tld}", f"{a}[at]{b}[dot]{tld}", f"{a} (at) {b}.{tld}", f"{a} @ {b}.{tld}"))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}",) * 3 + (f"({a}) {b}-{c}", f"({a}) {b} {c}", f"+49 {num(2)} {num(7)}", f"+{num(2)}.{a}.{b}.{c}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"))

    octet = lambda: str(rng.randint(0, 255))
    things = (
        (email, 0), (email, 0), (lambda: ".".join(octet() for _ in range(4)), 1), (lambda: card(True), 2), (lambda: card(True), 2), (phone, 3), (phone, 3),
        (lambda: card(False), None), (lambda: card(False), None), (lambda: "v" + ".".join(num(1) for _ in range(3)), None), (lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", None),
        (lambda: f"{rng.randint(256, 999)}.{octet()}.{octet()}.{octet()}", None), (lambda: num(rng.randint(4, 9)), None), (lambda: num(rng.randint(10, 15)), None), (lambda: f"{num(3)}-{num(3)}-{num(4)}", None),
        (lambda: f"{num(4)} {num(4)}", None), (lambda: f"{word()} at {word()}", None), (lambda: f"@{word()}", None), (lambda: f"{num(5)}.{num(4)}", None), (lambda: f"{num(3)}, {num(4)}, {num(4)}", None), (lambda: f"{num(20)}", None),
    )
    text, gold = "", []
    for _ in range(rng.randint(2, 4)):
        text += " ".join(word() for _ in range(rng.randint(1, 3))) + rng.choice((" ", " ", ", ", ". ", ": "))
        make, kind = rng.choice(things)
        x = make()
        if kind is not None:
            gold.append((len(text), len(text) + len(x), kind))
        text += x + rng.choice((" ", ". ", ", ", "\n", " ", "!! "))
    text += word()
    tokens, ends, at = [], {}, 0
    for m in _TOKEN.finditer(text):
        ends[m.start()] = len(tokens)
        tokens.append(m[0])
    ends[len(text)] = len(tokens)
    return tokens, {(ends[a], ends[b], k) for a, b, k in gold}


@functools.lru_cache(maxsize=2)
def fit(seed: int = 7) -> dict[str, list[float]]:
    """Weights for each feature and kind. The same in every process: the generator and the order are seeded."""
    rng = random.Random(seed)
    made = [(t, g, segments(t)) for t, g in (_sentence(rng) for _ in range(TRAIN))]
    weights: dict[str, list[float]] = {"bias": [-2.0] * OUT}
    for k in range(PASSES):
        rng.shuffle(made)
        for tokens, gold, found in made:
            _gradient(tokens, gold, found, weights, 0.4 / (1 + 0.5 * k), 1e-3)
    return {f: w for f, w in weights.items() if any(abs(x) > 1e-2 for x in w)}


def field_spans(text: str, weights: dict, after: list[list[float]] | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the field's entities over the whole text."""
    if not _MAY.search(text):
        return []
    tokens = _TOKEN.findall(text)
    spans = admissible(tokens)
    if not spans:
        return []
    places = [0, *itertools.accumulate(map(len, tokens))]
    after = after or _after(weights)
    out, at = [], 0
    while at < len(spans):
        low, high = spans[at]
        end = at + 1
        while end < len(spans) and spans[end][0] <= high:  # neighbours that touch are decoded together
            high = max(high, spans[end][1])
            end += 1
        out += [(k, places[i], places[j]) for i, j, k in _decoded(tokens, low, high, spans[at:end], weights, after)]
        at = end
    return out


def find(text: str | None, weights: dict, after: list[list[float]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    taken: list[list[int]] = []  # base spans merged, in order
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    added, at = [], 0
    for k, s, e in field_spans(text, weights, after):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at == len(taken) or taken[at][0] >= e:
            added.append((k, s, e))
    return base, sorted([*base, *added])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans as text."""
    weights = fit()
    after = _after(weights)

    def make():
        def step(c):
            both = [find(x, weights, after) for x in c["text"]]
            out = {"doc_id": c["doc_id"], "base": [joined(b) for b, _ in both], "spans": [joined(a) for _, a in both]}
            return out | {f"n_{k}": [sum(x[0] == i for x in b) for b, _ in both] for i, k in enumerate(KINDS)}

        return step

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string", make)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return personal_data(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
