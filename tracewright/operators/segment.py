"""Segmentation of traces into sentences and macro steps. Rules run in order and consume what follows, so a trace is one row of an Arrow map; one row comes
in and one goes out, and sentences and steps are exploded by Spark."""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as X
from ..sources.io import spread

_BULLET, _END = map(re.compile, (X.BULLET, X.SENTENCE_END))
_META, _EQ, _SYM, _CONT = map(re.compile, (X.META, X.EQUATION, X.SYMBOLIC, X.CONTINUATION))
_ROLES = {name: re.compile(pattern) for name, pattern in X.ROLES.items()}
_HELD = re.compile(r"⟦LATEX_(\d+)⟧")
#: X.LATEX_BLOCK by its openers and their closers.
_OPEN = re.compile(r"\$\$|\\\[|\\\(")
_CLOSE = {"$$": "$$", "\\[": "\\]", "\\(": "\\)"}
#: The words of X.ROLES: those that give a role alone, and pairs after which the role's own pattern is asked.
_ALONE = {
    w: name
    for name, words in {
        "plan": "plan strategy lets first next then step approach assume", "introduce": "let denote define set", "substitute": "substitute plug",
        "intermediate": "obtain get compute simplify simplifies combine rearrange collect expand", "check": "verify check substitution", "conclude": "therefore thus hence consequently",
    }.items()
    for w in words.split()
}
_PAIRS = [
    ("plan", "let", "s"), ("plan", "we", "will"), ("plan", "we", "shall"), ("check", "plug", "in"), ("check", "substitute", "back"),
    ("conclude", "in", "conclusion"), ("conclude", "final", "answer"), ("conclude", "answer", "is"),
]
_NONE: frozenset = frozenset()
_KEYS = frozenset(_ALONE) | {w for _, *pair in _PAIRS for w in pair}
_WORD = re.compile(r"\w+")
#: Of an ASCII text: capitals to small letters, what is no part of a word to blanks.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and (chr(i).isalnum() or chr(i) == "_") else 32 for i in range(256))
_BYTES = {w.encode(): w for w in _KEYS}
#: Letters that a pattern without case takes for i, s and k, and lower() doesn't.
_ALIKE = {"İ": "i", "ı": "i", "ſ": "s", "\u212a": "k"}
_FOLD = str.maketrans(_ALIKE)
#: Characters at the start of a step that settle whether it continues another, and at a seam that a phrase of `_final` may cross.
LEAD, SEAM = 32, 12
#: A sentence of so many characters, or a shorter one, joins the next one.
SHORT = 6
#: Words up to which neighbours are packed where merging alone doesn't reach the target.
PACK = 90
#: Steps that a trace is merged down to.
MOST = 26

SENTENCE = "struct<sid:int,text:string,start:int,end:int,tokens:int>"
STEP = (
    "struct<mid:int,start_sid:int,end_sid:int,text:string,role:string,has_equation:boolean,is_check:boolean,is_conclusion:boolean,tokens:int,"
    "rel_pos:double,len_chars:int,contains_boxed:int,support_hint:int,weak_conclude:int,cheap_score:double>"
)


def normal(text: str, fold: bool = True) -> str:
    text = text.replace("\r", "\n")
    text = unicodedata.normalize("NFKC", text) if fold and not text.isascii() else text
    if "\t" in text or "  " in text:
        text = re.sub(r"[ \t]{2,}|\t", " ", text)
    return (re.sub(r"\n{3,}", "\n\n", text) if "\n\n\n" in text else text).strip()


def held_blocks(text: str) -> tuple[str, list[str]]:
    """Text with its LaTeX blocks replaced by placeholders, and the blocks. A closer that is missing once isn't looked for again."""
    out, held, kept, at, missing = [], [], 0, 0, set()
    while m := _OPEN.search(text, at):
        end = -1 if m[0] in missing else text.find(_CLOSE[m[0]], m.end())
        if end < 0:
            missing.add(m[0])
            at = m.start() + 1
            continue
        out += [text[kept : m.start()], f"⟦LATEX_{len(held)}⟧"]
        at = kept = end + 2
        held.append(text[m.start() : at])
    return "".join(out) + text[kept:] if held else text, held


def _parted(line: str) -> list[str]:
    parts, start = [], 0
    for m in _END.finditer(line):
        parts.append(line[start : m.end(1)].strip())
        start = m.end()
    return [*parts, tail] if (tail := line[start:].strip()) else parts


def _split(text: str, variant: str) -> list[str]:
    """Sentences of a normalised text."""
    bare, held = held_blocks(text)
    parts: list[str] = []
    for line in bare.split("\n"):
        line = line.strip()
        mark = _BULLET.match(line)
        rest = line[mark.end() :] if mark else line
        if mark and variant != "v2":
            parts.append(rest)
        elif line:
            parts += _parted(rest)
    if held:
        parts = [_HELD.sub(lambda m: held[int(m[1])] if int(m[1]) < len(held) else m[0], x) for x in parts]
    joined, i = [], 0
    while i < len(parts):
        x = parts[i].strip()
        i += 1
        if x:
            if i < len(parts) and (len(x) <= SHORT or _META.match(x)):
                x = f"{x} {parts[i]}".strip()
                i += 1
            joined.append(x)
    return joined


def sentences(text: str | None, variant: str = "v1") -> list[tuple[int, int, str]]:
    """(start, end, sentence) in the normalised text. v1: a bulleted line stands whole, without its marker; v2: the marker goes and the rest is split; v3: v1
    without compatibility folding. LaTeX blocks are held while lines are split and put back before short sentences join the next; a sentence that isn't
    found as it stands (it was joined over a break) gets its place from the end of the one before."""
    text = normal(text or "", fold=variant != "v3")
    out, cursor = [], 0
    for x in _split(text, variant):
        at = text.find(x, cursor)
        at = cursor if at < 0 else at
        cursor = at + len(x)
        out.append((at, cursor, x))
    return out


def marks(text: str) -> tuple[bool, bool, set, bool]:
    """Whether the text has an equation, whether it has that or a symbol, the roles whose words it has (X.ROLES but derive), and whether it names the final
    answer. Words are found once and looked up, which tells the same as a pattern for each role."""
    eq = "=" in text or "≥" in text or "≤" in text or ("\\" in text and _EQ.search(text) is not None)
    dense = eq or "-" in text or "+" in text or "/" in text or "*" in text or "^" in text or ("\\" in text and _SYM.search(text) is not None)
    if text.isascii():
        found = _BYTES.keys() & text.encode().translate(_ASCII).split()
        found = {_BYTES[w] for w in found} if found else found
    else:
        found = _KEYS.intersection(_WORD.findall((text.translate(_FOLD) if any(c in text for c in _ALIKE) else text).lower()))
    names = _NONE
    if found:
        names = {_ALONE[w] for w in found if w in _ALONE}
        for name, first, second in _PAIRS:
            if first in found and second in found and name not in names and _ROLES[name].search(text):
                names.add(name)
    return eq, dense, names, _final(text)


def _role(eq: bool, dense: bool, names: set) -> str:
    if names:
        for name in _ROLES:
            if eq if name == "derive" else name in names:
                return name
    return "derive" if dense else "other"


def role_of(text: str) -> str:
    return _role(*marks(text)[:3])


def spans(parts: list[str], seen: list[tuple] | None = None) -> list[tuple[int, int]]:
    """First and end index of each macro step. seen: the parts' marks, if they are there already."""
    n, out, i = len(parts), [], 0
    seen = [marks(x) for x in parts] if seen is None else seen
    while i < n:
        x, j = parts[i], i + 1
        if j < n and _META.match(x):
            j += 1
        elif seen[i][1]:
            while j < n and seen[j][1]:
                j += 1
        elif "check" in seen[i][2]:
            j = min(n, i + 4)
        elif j < n and _CONT.match(x):
            j += 1
        elif j < n and ("conclude" in seen[i][2] or "\\boxed" in x) and not seen[j][2].isdisjoint(("conclude", "check")):
            j += 1
        out.append((i, j))
        i = j
    return out


def macro(parts: list[str], a: int, b: int, at: int, of: int, seen: list[tuple] | None = None) -> dict:
    """The step of parts[a:b], the one at `at` (from 0) of `of`. seen: the parts' marks, if they are there already."""
    text = parts[a] if b - a == 1 else " ".join(parts[a:b])
    text = text.strip()
    eq, dense, names, final = marks(text) if seen is None or b - a > 1 else seen[a]
    pos, boxed = (at + 1) / max(1, of), "\\boxed" in text
    return {
        "start_sid": a + 1, "end_sid": b, "text": text, "role": _role(eq, dense, names), "has_equation": dense, "is_check": "check" in names,
        "is_conclusion": "conclude" in names or boxed, "tokens": len(text.split()), "rel_pos": round(pos, 3), "weak_conclude": None,
        "cheap_score": round(min(1.0, 0.2 * pos + 0.15 * min(1, len(text) / 120) + 0.1 * boxed), 3),
        "final": final,
    }


def steps_of(parts: list[str]) -> list[dict]:
    """Unmerged steps of a trace's sentences."""
    seen = [marks(x) for x in parts]
    at = spans(parts, seen)
    return [macro(parts, a, b, i, len(at), seen) for i, (a, b) in enumerate(at)]


def concluded(step: dict) -> dict:
    """A boxed answer makes a conclusion; a concluding phrase alone is noted as a weak one. Adds what merging asks of a text: size, lead, tail, continues."""
    text = step["text"]
    step = step | {"size": len(text), "lead": text[:LEAD], "tail": text[-SEAM:], "continues": _CONT.match(text) is not None}
    if "\\boxed" in text:
        step["is_conclusion"], step["role"] = True, "conclude"
    elif step["is_conclusion"]:
        step["weak_conclude"] = 1
    return step


def _final(text: str) -> bool:
    return "\\boxed" in text or ("answer" in (low := text.lower()) and ("final answer" in low or "answer is" in low))


def wall(a: dict, b: dict) -> bool:
    """Whether two neighbours must not merge."""
    if a["final"] or b["final"] or (a["is_check"] and a["rel_pos"] >= 0.6) or (b["is_check"] and b["rel_pos"] >= 0.6):
        return True
    return a["role"] in ("introduce", "plan") and b["role"] in ("derive", "intermediate") and b["has_equation"]


def cost(a: dict, b: dict) -> float:
    """Of a merge: what speaks against it less what speaks for it."""
    ra, rb, la, lb = a["role"], b["role"], a["size"], b["size"]
    c = 0.0 if ra == rb else 0.9 if (ra in ("derive", "intermediate")) != (rb in ("derive", "intermediate")) else 0.4
    c += 0.8 * (a["has_equation"] != b["has_equation"])
    c -= 0.8 * (a["tokens"] < 18 or b["tokens"] < 18)
    c -= 0.4 * (la < 60 and lb < 60)
    c -= 0.3 * b["continues"]
    return c + 0.2 * (abs(la - lb) / max(1, la, lb))


def _grow(a: dict, b: dict) -> dict:
    """a with b joined to it, in place, but for its text: a merge costs the same however long the two are."""
    if not a["final"]:
        seam = f"{a['tail']} {b['lead'][:SEAM]}"
        a["final"] = b["final"] or _final(seam)
    for k in ("has_equation", "is_check", "is_conclusion"):
        a[k] = a[k] or b[k]
    if a["size"] < LEAD:
        a["lead"] = f"{a['lead']} {b['lead']}"[:LEAD]
        a["continues"] = _CONT.match(a["lead"]) is not None
    a["tail"] = b["tail"] if b["size"] >= SEAM else f"{a['tail']} {b['tail']}"[-SEAM:]
    a["role"] = b["role"] if a["role"] == "other" else a["role"]
    a["end_sid"], a["tokens"], a["size"] = b["end_sid"], a["tokens"] + b["tokens"], a["size"] + 1 + b["size"]
    return a


def joined(a: dict, b: dict) -> dict:
    return _grow(dict(a), b) | {"text": f"{a['text']} {b['text']}"}


def _placed(steps: list[dict]) -> list[dict]:
    for i, x in enumerate(steps, 1):
        x["rel_pos"] = round(i / len(steps), 3)
    return steps


def _merged(steps: list[dict], most: int) -> list[dict]:
    """Cheapest neighbours merge, leftmost first, until no more than `most` are left or walls stand between all. A heap holds the pairs; an entry counts
    only while neither step has changed since. Steps change in place; their texts are joined at the end."""
    n = len(steps)
    after, before, changed = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap: list[tuple] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and not wall(steps[i], steps[after[i]]):
            j = after[i]
            heapq.heappush(heap, (cost(steps[i], steps[j]), i, j, changed[i], changed[j]))

    for i in range(n):
        offer(i)
    left, gone = n, [False] * n
    while left > most and heap:
        _, i, j, ci, cj = heapq.heappop(heap)
        if gone[i] or gone[j] or after[i] != j or changed[i] != ci or changed[j] != cj:
            continue
        _grow(steps[i], steps[j])
        gone[j], after[i] = True, after[j]
        changed[i] += 1
        left -= 1
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    texts = [x["text"] for x in steps]
    kept = [i for i in range(n) if not gone[i]]
    for i in kept:
        steps[i]["text"] = " ".join(texts[i : after[i]])
    return [steps[i] for i in kept]


def compressed(steps: list[dict], most: int = MOST) -> list[dict]:
    """Conclusions are marked, then neighbours merge; where that doesn't reach `most`, they are packed by words, and walls still hold. Positions and scores
    during merging are those from before it."""
    steps = _placed([concluded(x) for x in steps])
    if len(steps) > most:
        steps = _merged(steps, most)
    if len(steps) > most:
        packed: list[dict] = []
        for x in steps:
            if packed and not wall(packed[-1], x) and packed[-1]["tokens"] + x["tokens"] <= PACK:
                packed[-1] = joined(packed[-1], x)
            else:
                packed.append(x)
        steps = packed
    return _placed(steps)


def core(gold: str | None) -> str:
    gold = (gold or "").strip()
    m = re.match(X.BOXED_WHOLE, gold)
    return m[1].strip() if m else gold


def finished(steps: list[dict], gold: str | None) -> list[dict]:
    """The steps, given their numbers and final features; support_hint: the gold answer's core stands in the text."""
    hint = core(gold)
    for i, x in enumerate(steps, 1):
        text = x["text"]
        x["mid"], x["len_chars"], x["contains_boxed"], x["support_hint"] = i, len(text), int("\\boxed" in text), int(bool(hint) and hint in text)
    return steps


def candidates(steps: list[dict], k: int) -> list[int]:
    """Numbers of the k steps of highest score, earlier ones first among equals."""
    return [x["mid"] for x in sorted(steps, key=lambda x: -x["cheap_score"])[: max(0, k)]]


def _mapped(df: DataFrame, inputs: list[str], added: str, f) -> DataFrame:
    """df with the columns `added`, a struct of what f makes of a row's inputs. Other columns pass by untouched."""
    df = spread(df)
    target = StructType([*df.schema, *StructType.fromDDL(added)])
    schema = to_arrow_schema(target)
    new = [x for x in schema if x.name not in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [f(*x) for x in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[x.name] for r in rows], type=x.type) for x in new)], names=schema.names)

    return df.mapInArrow(run, target)


def with_sentences(df: DataFrame, text: str, variant: str = "v1") -> DataFrame:
    """df with sentences: array of sid (from 1), text, start, end, tokens."""
    f = lambda t: {"sentences": [{"sid": i, "text": x, "start": a, "end": b, "tokens": len(x.split())} for i, (a, b, x) in enumerate(sentences(t, variant), 1)]}
    return _mapped(df, [text], f"sentences array<{SENTENCE}>", f)


def _trace(parts: list[str], gold: str | None, most: int | None, top: int) -> tuple[list[dict], list[int]]:
    """Finished steps of a trace's sentences, and the candidates among them."""
    steps = steps_of(parts)
    steps = finished(compressed(steps, most) if most else steps, gold)
    return steps, candidates(steps, top)


def with_steps(df: DataFrame, text: str, gold: str | None = None, most: int | None = MOST, top: int = 0) -> DataFrame:
    """df with sentences, macro_steps and candidate_macro_ids (the `top` steps of highest score). most: None leaves steps unmerged. gold: a column."""

    def f(t, g=None):
        found = sentences(t)
        steps, best = _trace([x for _, _, x in found], g, most, top)
        return {
            "sentences": [{"sid": i, "text": x, "start": a, "end": b, "tokens": len(x.split())} for i, (a, b, x) in enumerate(found, 1)],
            "macro_steps": steps, "candidate_macro_ids": best,
        }

    return _mapped(df, [text, *([gold] if gold else [])], f"sentences array<{SENTENCE}>, macro_steps array<{STEP}>, candidate_macro_ids array<int>", f)


def _rows(df: DataFrame, key: str, inputs: list[str], added: str, f) -> DataFrame:
    """key and the columns `added`: a row for each that f makes of a row's inputs. Texts go one way only, and rows come back flat."""
    df = spread(df.select(*dict.fromkeys([key, *inputs])))
    target = StructType([*df.select(key).schema, *StructType.fromDDL(added)])
    schema = to_arrow_schema(target)
    new = list(schema)[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [f(*x) for x in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                keys = part.column(key).take(pa.array([i for i, rows in enumerate(made) for _ in rows], type=pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([x[c.name] for rows in made for x in rows], type=c.type) for c in new)], names=schema.names)

    return df.mapInArrow(run, target)


def sentence_rows(df: DataFrame, key: str, text: str, variant: str = "v1") -> DataFrame:
    """key and the fields of each sentence."""
    f = lambda t: [{"sid": i, "text": x, "start": a, "end": b, "tokens": len(x.split())} for i, (a, b, x) in enumerate(sentences(t, variant), 1)]
    return _rows(df, key, [text], SENTENCE[len("struct<") : -1], f)


def macro_rows(df: DataFrame, key: str, text: str, most: int | None = None, gold: str | None = None, top: int | None = None) -> DataFrame:
    """key and the fields of each macro step; merged down to `most` if given. top: with candidate_macro_ids before the fields."""

    def f(t, g=None):
        steps, best = _trace(_split(normal(t or ""), "v1"), g, most, top or 0)
        for x in steps:
            x["candidate_macro_ids"] = best
        return steps

    return _rows(df, key, [text, *([gold] if gold else [])], ("" if top is None else "candidate_macro_ids array<int>,") + STEP[len("struct<") : -1], f)


def correctness(answer: Column, gold: Column, verified: Column, judged: Column) -> Column:
    """Struct is_correct, verified_by: the verifier's word, else the judge's, else equality of the two answers' cores, else null and 'unknown'."""
    both = (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(gold, F.lit("")) != "")
    pick = lambda ok, by: F.struct(ok.cast("boolean").alias("is_correct"), F.lit(by).alias("verified_by"))
    out = F.when(verified.isNotNull(), pick(verified, "math_verify")).when(judged.isNotNull(), pick(judged, "llama_judge"))
    return out.when(both, pick(X.unwrapped(answer) == X.unwrapped(gold), "string_match")).otherwise(pick(F.lit(None), "unknown"))
