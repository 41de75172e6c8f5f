"""Secret scans: fixed patterns, and a guess-cost dynamic programme over values in a credential context.

The programme finds the cheapest way to guess a value as a sequence of common words, dates, repeats,
keyboard walks, plain words and brute-force spans. A value that stays dear is a secret even where no fixed pattern
fits; a cheap one ("password is required") is not.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, in_arrow, table
from .kernels import slices

KINDS = ("assign", "access", "hex", "guess")
#: Patterns fixed by the task; the value of the first is its group 2.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: What may stand before a credential, and how it is tied to its value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|client|auth)[_-]?(?:key|token|secret)|credentials?|bearer)["'`]?(?:\s{0,3}(?:[:=]>?|->)\s{0,3}|\s{1,3}(?:is|was|est|ist|es)\s{1,3})["'`]?([^\s"'`<>,;]{6,})|://[^\s/:@"'<>]++:([^\s/@"'<>]{6,}+)@""",
    re.IGNORECASE | re.ASCII,
)
#: log10 of the guesses from which a value counts as a secret.
DEAR = 8.0
#: A slice without any of these (lower case) has no credential context.
CUE = re.compile(rb"pass|pwd|secret|token|api[_-]?key|key|credential|bearer|://")
MARKS = (re.compile(rb"AKIA[A-Z0-9]{16}"), re.compile(rb"[0-9a-f]{24}"))

#: Common parts of passwords, the most common first.
WORDS = (
    "password pass admin welcome login letmein monkey dragon master hello secret shadow sunshine princess football "
    "baseball superman batman trustno iloveyou love user test guest root default change changeme temp summer winter spring "
    "autumn monday friday january february march april june july august september october november december london paris "
    "berlin madrid freedom whatever computer internet server system service example sample demo public private token key "
    "access account email phone required invalid missing empty null none true false value string number name first last "
    "your the and for not has with from this that must reset forgot confirm enter new old strong weak"
).split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_LEET = str.maketrans("@4310$5!7", "aaeiossit")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d"
)
#: Characters of the shortest and the longest date.
_DATE_LENGTHS = (5, 10)
_UNITS = 8
#: Steps of a walk and turns of a repeat that are offered at every number up to this; longer ones also as far as they go.
_EACH = 32
#: A plain word: log10 of the guesses at least (a large dictionary) and for each letter (1.3 bits of running text), and
#: its letters at least and at most.
WORD, LETTER = 5.5, 0.4
_WORD_LETTERS = (4, 40)
_VOWELS = frozenset("aeiouy")
#: Pairs of consonants that stand in words of the languages of Western Europe; random letters seldom keep to them.
_PAIRS = frozenset(
    "bb bl br bs bt cc ch ck cl cn cq cr cs ct dd dg dj dl dm dn dr ds dt dv dw ff fl fr fs ft gg gh gl gm gn gr gs gt hl hm hn hr "
    "hs ht hw kk kl kn kr ks kt kw lb lc ld lf lg lh lk ll lm ln lp lr ls lt lv lw lz mb mf ml mm mn mp ms mt nb nc nd nf ng nh "
    "nj nk nl nm nn np nq nr ns nt nv nw nz pf ph pl pp pr ps pt qu rb rc rd rf rg rh rj rk rl rm rn rp rq rr rs rt rv rw rz sb sc "
    "sf sg sh sk sl sm sn sp sq sr ss st sw sz tb tc tf th tl tm tn tr ts tt tw tz vr wh wk wl wn wr ws xc xp xt zl zt zw zz".split()
)


def _class(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def word_ends(low: str) -> list[int]:
    """For each place of a lower-case value, how far letters go on that may be one word: pairs that occur, few vowels in a
    row. Letters beyond ASCII go with any other."""
    n = len(low)
    end, vowels = [0] * n, [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = low[i]
        if not c.isalpha():
            continue
        vowels[i] = vowels[i + 1] + 1 if c in _VOWELS else 0
        d = low[i + 1] if i + 1 < n and low[i + 1].isalpha() else ""
        goes = d and (c in _VOWELS or d in _VOWELS or not c.isascii() or not d.isascii() or c + d in _PAIRS) and vowels[i] <= 3
        end[i] = end[i + 1] if goes else i + 1
    return end


def walk_runs(low: str) -> tuple[list[int], list[int], list[int]]:
    """For each place of a lower-case value how many keyboard steps follow, the changes of direction before each place,
    and how many steps through the alphabet or the digits in one direction follow."""
    n = len(low)
    steps: list[tuple[int, int] | None] = []
    for c, d in itertools.pairwise(low):
        a, b = _KEY.get(c), _KEY.get(d)
        near = a is not None and b is not None and abs(b[0] - a[0]) <= 1 and abs(b[1] - a[1]) <= 1
        following = c.isalnum() and abs(ord(d) - ord(c)) == 1
        steps.append((b[0] - a[0], b[1] - a[1]) if near else (9, ord(d) - ord(c)) if following else None)
    walk, row = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 2, -1, -1):
        if steps[i] is not None:
            walk[i] = walk[i + 1] + 1
        step = ord(low[i + 1]) - ord(low[i])
        if low[i].isalnum() and low[i + 1].isalnum() and abs(step) == 1:
            row[i] = row[i + 1] + 1 if row[i + 1] and ord(low[i + 2]) - ord(low[i + 1]) == step else 1
    turns = [0] * (n + 1)
    for i in range(1, n - 1):
        turns[i] = turns[i - 1] + (steps[i] != steps[i - 1])
    return walk, turns, row


def lengths_of(most: int, least: int) -> list[int]:
    """What is offered of a run that goes on for `most`: each number up to _EACH, and all of it."""
    return [*range(least, min(most, _EACH) + 1), *([most] if most > _EACH else [])]


def segments(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of the guesses) of all segments that the programme may put together, in order of start.

    A walk costs its first key, its length and its turns; a repeat its unit and how often it comes; a word its rank, or
    what a large dictionary holds; anything else is brute force, one character at a time.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(_LEET)
    # How far each place goes on repeating a unit of u characters.
    again = []
    for u in range(1, _UNITS + 1):
        run = [0] * (n + 1)
        for i in range(n - u - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + u] else 0
        again.append(run)
    walk, turns, row = walk_runs(low)
    words, (short, long) = word_ends(low), _WORD_LETTERS
    # The first place from each on with a vowel or a letter beyond ASCII, and with a capital: what a word has and how it is written.
    sound, capital = [n] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        sound[i] = i if low[i] in _VOWELS or not low[i].isascii() else sound[i + 1]
        capital[i] = i if value[i] != low[i] else capital[i + 1]
    for i in range(n):
        yield i, i + 1, _class(value[i])
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j]) or (_RANK.get(plain[i:j], 0) and 2 * _RANK[plain[i:j]])
            if rank:
                yield i, j, math.log10(rank + 1) + (0.0 if value[i:j].islower() else math.log10(2))
        for j in range(max(i + short, sound[i] + 1), min(words[i], i + long) + 1):
            # In small letters, with a capital at its start, or all in capitals.
            if capital[i] >= j or capital[i + 1] >= j or value[i:j].isupper():
                yield i, j, max(WORD, LETTER * (j - i)) + (0.0 if capital[i] >= j else math.log10(2))
        if value[i].isdigit():
            if _YEAR.match(value, i):
                yield i, i + 4, math.log10(200)
            for j in range(i + _DATE_LENGTHS[0], min(n, i + _DATE_LENGTHS[1]) + 1):
                if _DATE.fullmatch(value, i, j):
                    yield i, j, math.log10(365 * 200)
        for u, run in enumerate(again, 1):
            # A unit that repeats a shorter one itself is that one, oftener.
            if not run[i] or any(u % v == 0 and again[v - 1][i] >= u for v in range(1, u)):
                continue
            low_unit = low[i : i + u]
            unit = min(sum(map(_class, value[i : i + u])), math.log10(_RANK[low_unit] + 1) if low_unit in _RANK else math.inf)
            for count in lengths_of((run[i] + u) // u, 3 if u == 1 else 2):
                yield i, i + count * u, unit + math.log10(count)
        for k in lengths_of(walk[i], 2):
            yield i, i + k + 1, math.log10(47 * (k + 1)) + (1 + turns[i + k - 1] - turns[i]) * math.log10(8)
        for k in lengths_of(row[i], 2):
            yield i, i + k + 1, math.log10(47 * (k + 1)) + math.log10(8)


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation of a value; 0 for an empty one.

    Time and memory follow the length of the value: each place starts a bounded number of segments.
    """
    best = [0.0] + [math.inf] * len(value)
    for i, j, cost in segments(value):
        if best[i] + cost < best[j]:
            best[j] = best[i] + cost
    return best[len(value)]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the fixed patterns."""
    found = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def guessed_spans(text: str, base: list[tuple[int, int, str, int]], dear: float = DEAR) -> list[tuple[int, int, str, int]]:
    """Values in a credential context that are dear to guess, without the parts of them that base spans hold."""
    out = []
    for m in CONTEXT.finditer(text):
        group = 1 if m[1] is not None else 2
        start, value = m.start(group), m[group].rstrip(".:!?)]}")
        end = start + len(value)
        if len(value) < LEAST_VALUE:
            continue
        parts, at = [], start
        for s, e, _, _ in sorted(x for x in base if x[0] < end and start < x[1]):
            if s > at:
                parts.append((at, s, "guess", at))
            at = max(at, e)
        if at < end:
            parts.append((at, end, "guess", at))
        if parts and guess_cost(value) >= dear:
            out += parts
    return out


def all_spans(text: str, dear: float = DEAR) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int, str, int]]]:
    """Base spans, and all spans with those that the guess cost adds."""
    base = base_spans(text)
    more = guessed_spans(text, base, dear)
    return base, sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def suspects(data, offsets) -> list[int]:
    """Texts of a slice that may hold a span: a cheap test over the bytes, exact for the fixed patterns."""
    import numpy as np

    # A byte between texts that no pattern can match: what ends one text neither joins nor uses up what begins the next.
    whole = data.tobytes()
    raw = b"\x00".join([whole[a:b] for a, b in itertools.pairwise(offsets.tolist())])
    places = [m.start() for m in CUE.finditer(raw.lower())]
    for mark in MARKS:
        places += [m.start() for m in mark.finditer(raw)]
    starts = offsets[:-1] + np.arange(len(offsets) - 1)
    return np.unique(np.searchsorted(starts, np.array(places, np.int64), "right") - 1).tolist() if places else []


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def secret_spans(docs: DataFrame, *, dear: float = DEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, max_cost for each row of docs.

    max_cost: the dearest value of an assign or guess span, null without one. Null and empty texts have no spans;
    repeated rows come back each; other columns don't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    none = hashlib.sha256(b"").hexdigest()

    def per_batch(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column(1)):
            n = b - a
            counts = {k: [0] * n for k in KINDS}
            digest, spans, dearest = [none] * n, [""] * n, [None] * n
            for t in suspects(data, offsets):
                text = data[offsets[t] : offsets[t + 1]].tobytes().decode()
                base, every = all_spans(text, dear)
                if not every:
                    continue
                for _, _, k, _ in every:
                    counts[k][t] += 1
                digest[t] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[t] = joined(every)
                costs = [guess_cost(text[v:e]) for _, e, k, v in every if k in ("assign", "guess")]
                dearest[t] = round(max(costs), 6) if costs else None
            yield batch_of(
                doc_id=batch.column(0).slice(a, n),
                **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in KINDS},
                base_sha256=digest,
                spans=spans,
                max_cost=pa.array(dearest, pa.float64())
            )

    return in_arrow(
        docs.select(id_col, text_col),
        per_batch,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_cost double",
    )


def redacted(docs: DataFrame, *, mark: str = "[SECRET]", dear: float = DEAR, text_col: str = "text") -> DataFrame:
    """docs with each secret value replaced by a mark (of an assignment its value only); n_chars follows the text.

    Null and empty texts, and texts without a secret, stay as they are; repeated rows come back each; other columns,
    null or not, pass through; an empty table gives an empty one.
    """
    place, length = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def per_batch(batch: pa.RecordBatch):
        new: dict[int, str] = {}
        for a, _, data, offsets in slices(batch.column(place)):
            for t in suspects(data, offsets):
                text = data[offsets[t] : offsets[t + 1]].tobytes().decode()
                at, out = 0, []
                for _, end, _, value in all_spans(text, dear)[1]:
                    if end > at:
                        out += [text[at : max(at, value)], mark if value >= at else ""]
                        at = end
                if out:
                    new[a + t] = "".join(out) + text[at:]
        if new:
            for column, of in ((place, str), (length, len)):
                if column is not None:
                    field = batch.schema.field(column)
                    values = batch.column(column).to_pylist()
                    for i, text in new.items():
                        values[i] = of(text)
                    batch = batch.set_column(column, field, pa.array(values, field.type))
        yield batch

    return in_arrow(docs, per_batch, docs.schema)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", F.col("max_cost"))
