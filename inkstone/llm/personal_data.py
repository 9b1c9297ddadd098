"""Personal data: patterns find the usual notations, a semi-Markov conditional random field the unusual ones, whole spans at a time."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, released, short_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Documents whose texts the model is trained on at most (those of the lowest hash); excerpts of one; code points of one.
SAMPLE, EXCERPTS, AROUND = 1_000, 6, 120
#: Tokens, code points and digits of a span at most, which bounds the dynamic programme's steps.
LONGEST, WIDEST, DIGITS = 24, 160, 20
EPOCHS, RATE, DECAY = 4, 0.3, 1e-4
SEED = 13

# The base patterns. Possessive where no match could give anything back, so that long runs are read once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs that hold all of a match of the last three, and numbers written otherwise.
ISLAND = re.compile(r"[0-9][\x20().0-9+/\[\]\n-]*")

#: How the at and the dots of an address are written out.
AT = re.compile(r"@|\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20", re.IGNORECASE)
DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
BEHIND = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}})+", re.IGNORECASE)
AHEAD = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}(?:{DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}$", re.IGNORECASE)
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")

#: What a span may begin and end with.
STARTS, ENDS = LOCAL - frozenset("._%-") | {"("}, LOCAL - frozenset("._%+-")

Span = tuple[str, int, int]


def digits(text: str) -> list[int]:
    return [int(c) for c in text if c in "0123456789"]


def luhn(number: list[int]) -> bool:
    """The check sum of card numbers: from the right every second digit counts twice, by its digit sum."""
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def is_ip(text: str) -> bool:
    # A part of any length has a value; leading zeros do not add to it.
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    number = digits(text) if len(text) <= 64 else []
    return 12 <= len(number) <= 19 and luhn(number)


def is_phone(text: str) -> bool:
    return 9 <= sum(c in "0123456789" for c in text) <= 15


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: what stands before an @ in one run, from the last match's end on, and a domain behind it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield "email", start, free
        at = text.find("@", free)


def base(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns' matches that hold, by start, then kind."""
    found = list(emails(text))
    for island in ISLAND.finditer(text):
        lo, hi = island.span()
        for kind, pattern, holds in (("ip", IP, is_ip), ("card", CARD, is_card)):
            found += [(kind, *m.span()) for m in pattern.finditer(text, lo, hi) if holds(m[0])]
        lo -= lo > 0 and text[lo - 1] == "+"
        if text.find("+", lo, hi) >= 0:
            found += [("phone", *m.span()) for m in PHONE.finditer(text, lo, hi) if is_phone(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def regions(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Stretches of ``text`` outside ``taken`` that may hold a span: runs of digits and their marks with at least four digits, and addresses written out. Elsewhere no span has a start."""
    free = [0, *(x for _, s, e in taken for x in (s, e)), len(text)]
    gaps, end = [], 0
    for s, e in sorted((s, e) for _, s, e in taken):
        gaps.append((end, s))
        end = max(end, e)
    gaps.append((end, free[-1]))
    for lo, hi in gaps:
        for m in ISLAND.finditer(text, lo, hi):
            a, b = m.span()
            while a > lo and text[a - 1] in "+(":
                a -= 1
            if b - a >= 4 and sum(c in "0123456789" for c in text[a : min(b, a + 64)]) >= 4:
                yield a, b
        done = lo
        for m in AT.finditer(text, lo, hi):
            behind = BEHIND.match(text, m.end(), hi) if m.start() >= done else None
            ahead = behind and AHEAD.search(text, max(done, m.start() - 200), m.start())
            if ahead:
                done = behind.end()
                yield ahead.start(), done


def tokens(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, lo, hi)]


def spans_from(text: str, at: list[tuple[int, int]], i: int) -> Iterator[tuple[int, str, tuple[str, ...]]]:
    """(token behind the last, kind, features) of the candidate spans that begin with token ``i``: at most ``LONGEST`` tokens, ``WIDEST`` code points and ``DIGITS`` digits."""
    start, n = at[i][0], 0
    if text[start] not in STARTS:
        return
    left = near(text, start - 1, -1)
    for j in range(i + 1, min(len(at), i + LONGEST) + 1):
        first, end = at[j - 1]
        n += end - first if text[first] in "0123456789" else 0
        if n > DIGITS or end - start > WIDEST:
            return
        if text[end - 1] in ENDS:
            for kind, about in candidate(text[start:end], left, near(text, end, 1)):
                yield j, kind, about


class Lattice:
    """The tokens of a stretch of text and its candidate spans: (first token, token behind the last, kind, features)."""

    def __init__(self, text: str, lo: int, hi: int):
        self.at = tokens(text, lo, hi)
        self.spans = [(i, *s) for i in range(len(self.at)) for s in spans_from(text, self.at, i)]

    def place(self, span: Span) -> tuple[int, int, str] | None:
        """A span by tokens, if it begins and ends with one and is among the candidates."""
        kind, start, end = span
        i, j = next((k for k, t in enumerate(self.at) if t[0] == start), -1), next((k + 1 for k, t in enumerate(self.at) if t[1] == end), -1)
        return next(((a, b, k) for a, b, k, _ in self.spans if (a, b, k) == (i, j, kind)), None)


def sort_of(c: str) -> str:
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def near(text: str, at: int, step: int) -> str:
    """The sort of character beside a span; behind one space, that and the next one's."""
    if not 0 <= at < len(text):
        return "edge"
    sort, beyond = sort_of(text[at]), at + step
    return f"space {sort_of(text[beyond])}" if text[at] == " " and 0 <= beyond < len(text) else sort


@lru_cache(maxsize=1 << 12)
def candidate(part: str, left: str, right: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The kinds that a span may be of, with the features of the whole span and what is beside it. What the base patterns ask of parts, digits and check sums holds for all spans."""
    first, last, found = part[0], part[-1], []
    beside = (f"left {left}", f"right {right}")
    if last.isdigit() and (first.isdigit() or first in "+(") and all(c in "0123456789 ().+-/[]\n" for c in part):
        groups = re.findall("[0-9]+", part)
        n = sum(map(len, groups))
        if n < 4:
            return ()
        marks = re.split("[0-9]+", part)
        inner = " ".join(sorted({m.replace(" ", "_").replace("\n", "~") for m in marks[1:-1]}))
        lead = "+" if part.startswith("+") else "00" if part.startswith("00") else marks[0] or ("0" if part[0] == "0" else "n")
        shape = "-".join(str(len(g)) for g in groups[:7])
        numbers = ("all", f"lead {lead}", f"marks {inner}", f"shape {shape}", f"shape {shape} marks {inner}", f"n {n}", f"groups {min(len(groups), 7)}", *beside, f"open {part.count('(') == part.count(')')}")
        if len(groups) == 4 and all(int(g) <= 255 for g in groups):
            found.append(("ip", (*numbers, f"zeros {any(len(g) > 1 and g[0] == '0' for g in groups)}")))
        if 12 <= n <= 19 and luhn(digits(part)):
            found.append(("card", (*numbers, f"n {n} groups {min(len(groups), 7)}", f"first {groups[0][0]}")))
        if 9 <= n <= 15:
            found.append(("phone", (*numbers, f"lead {lead} n {n}", f"lead {lead} groups {min(len(groups), 7)}", f"lead {lead} marks {inner}")))
    elif last.isalpha() and first.isalnum() and (m := AT.search(part)) and m.start() > 0:
        domain = BEHIND.fullmatch(part, m.end())
        if not domain or not AHEAD.fullmatch(part, 0, m.start()):
            return ()
        dots = re.findall(DOT, part[m.end() :], re.IGNORECASE)
        at, style = m[0].strip().lower() or "@", " ".join(sorted({d.strip().lower() for d in dots}))
        top = re.split(DOT, part, flags=re.IGNORECASE)[-1]
        found.append(("email", ("all", f"at {at}", f"dot {style}", f"at {at} dot {style}", f"top {min(len(top), 7)} {top.islower()}", f"labels {min(len(dots), 4)}", f"words {len(re.findall(AT, part))}", *beside)))
    return tuple(found)


class Model:
    """Weights of (kind, feature), and what follows from them: scores, best choice, probabilities."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = {} if weights is None else weights

    def scores(self, lattice: Lattice) -> list[float]:
        w = self.weights
        return [sum(w.get(f"{kind} {f}", 0.0) for f in about) for _, _, kind, about in lattice.spans]

    def best(self, text: str, at: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The spans of the best segmentation of the tokens ``at``: the best that ends at each place is carried on by a token outside all spans (0) or by a span that begins there. Of equals the one with fewer spans. Candidates are made as they are met, so only the places are held."""
        best, back, w = [0.0] + [-math.inf] * len(at), [None] * (len(at) + 1), self.weights
        for i in range(len(at)):
            if best[i] >= best[i + 1]:
                best[i + 1], back[i + 1] = best[i], None
            for j, kind, about in spans_from(text, at, i):
                score = best[i] + sum(w.get(f"{kind} {f}", 0.0) for f in about)
                if score > best[j] and score > best[i]:
                    best[j], back[j] = score, (i, j, kind)
        out, j = [], len(at)
        while j > 0:
            if back[j]:
                out.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def shares(self, lattice: Lattice) -> list[float]:
        """The probability of each candidate span, by sums over all segmentations from both ends."""
        scores, n = self.scores(lattice), len(lattice.at)
        ends, starts = defaultdict(list), defaultdict(list)
        for s, score in zip(lattice.spans, scores, strict=True):
            ends[s[1]].append((score, s[0]))
            starts[s[0]].append((score, s[1]))
        front, rear = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            front[j] = log_sum([front[j - 1], *(front[i] + x for x, i in ends[j])])
        for i in range(n - 1, -1, -1):
            rear[i] = log_sum([rear[i + 1], *(rear[j] + x for x, j in starts[i])])
        return [math.exp(front[s[0]] + x + rear[s[1]] - front[n]) for s, x in zip(lattice.spans, scores, strict=True)]


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def train(examples: list[tuple[Lattice, list[tuple[int, int, str]]]], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights of the highest likelihood of the examples' segmentations, by gradient steps that shrink with what a weight has moved; small weights go."""
    weights: dict[str, float] = defaultdict(float)
    moved: dict[str, float] = defaultdict(float)
    model = Model(weights)
    for _ in range(epochs):
        for lattice, truth in examples:
            slope: dict[str, float] = defaultdict(float)
            for (i, j, kind, about), p in zip(lattice.spans, model.shares(lattice), strict=True):
                g = ((i, j, kind) in truth) - p
                if abs(g) > 1e-6:
                    for f in about:
                        slope[f"{kind} {f}"] += g
            for f, g in slope.items():
                moved[f] += g * g
                weights[f] += RATE * g / math.sqrt(moved[f]) - DECAY * weights[f]
    return {f: round(w, 6) for f, w in sorted(weights.items()) if abs(w) > 1e-3}


def invented(rng: random.Random) -> tuple[str, str | None]:
    """A made-up piece of personal data, in a usual notation or in one that the base patterns miss, or (None) something that looks like one: kinds and notations by turns of chance."""

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))

    def octet() -> str:
        return str(rng.randint(0, 255))

    def card(valid: bool) -> list[str]:
        sizes = rng.choice([(4, 4, 4, 4)] * 3 + [(4, 6, 5)])
        number = [rng.choice("3456"), *d(sum(sizes) - 2)]
        check = next(c for c in "0123456789" if luhn(digits("".join(number) + c)) == valid)
        number, out = "".join(number) + check, []
        for n in sizes:
            out.append(number[:n])
            number = number[n:]
        return out

    kind, usual = rng.choice([*KINDS, None, None, None]), rng.random() < 0.3
    if kind == "email":
        if usual:
            return f"{name()}{d(1)}@{name()}.com", kind
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("{at}", "{dot}"), (" (at) ", "."), (" [at] ", "."), ("(at)", "."), ("[at]", "."), ("@", "[dot]"), ("@", " dot "), ("@", "(dot)"), (" AT ", " DOT ")])
        local = rng.choice([name(), f"{name()}.{name()}", f"{name()}_{d(2)}", name() + d(2), f"{name()}{dot}{name()}"])
        return local + at + rng.choice([name(), f"mail{dot}{name()}", name() + d(1)]) + dot + rng.choice(["com", "org", "net", "de", "fr", "es", "co"]), kind
    if kind == "ip":
        marks = (".", ".", ".") if usual else rng.choice([(".", ".", "[.]"), ("[.]", "[.]", "[.]"), ("(.)", "(.)", "(.)"), (".", "[.]", "."), (" . ", " . ", " . ")])
        return octet() + "".join(m + octet() for m in marks), kind
    if kind == "card":
        return rng.choice(["", "", " ", "-"] if usual else [".", "/", "  ", " - ", "--", "\n"]).join(card(True)), kind
    if kind == "phone":
        a, b, c, cc = str(rng.randint(2, 9)) + d(2), d(3), d(4), rng.choice(["1", "33", "34", "44", "49", "351"])
        if usual:
            return rng.choice([f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc}{a}{b}{c}"]), kind
        return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"00{cc} {a} {b} {c}", f"00{cc}-{a}-{b}{c}", f"+{cc}/{a}/{b}{c}", f"(0{a}) {b}{c}", f"(+{cc}) {a} {b} {c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}"]), kind
    year, month, day = str(rng.randint(1900, 2099)), f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"
    wrong = card(False)
    if usual:
        return rng.choice(["", "", " ", "-", ".", "/"]).join(wrong), None
    return rng.choice([
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}/{month}/{day}", f"{year}-{int(year) + 5}", f"{year} - {int(year) + 5}", f"{day}.{month}.{year} {day}", f"{year}{month}{day}-{d(4)}",
        f"{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}.{d(3)}.{d(2)}", f"{octet()}.{octet()}.{octet()}.{rng.randint(256, 999)}", f"{d(1)}.{d(1)}.{rng.randint(256, 9999)}[.]{d(1)}", f"{rng.randint(256, 999)} . {octet()} . {octet()} . {octet()}",
        "  ".join(wrong), d(rng.randint(4, 20)), f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(2)}-{d(3)}-{d(2)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}-{d(2)}", f"({year})", f"({d(3)}) {d(4)}", f"{d(3)}.{d(3)}", f"{d(1)}.{d(3)}.{d(3)}", f"{d(2)}.{d(3)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)}", f"{d(4)}/{d(5)}", f"[{d(1)}] [{d(2)}] [{d(4)}]", f"{d(5)}-{d(4)}", f"{d(2)}-{d(7)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(6)}/{d(6)}",
        f"{name()} at {name()}.{name().capitalize()}", f"{name()} at {name()}. {name()}", f"{name()} at {name()}-{name()}", f"{name()} at {d(2)}.{d(2)}", f"{name()} at {name()} {name()}", f"{name()} at {name()}.{name()}", f"look at {name()}.com",
    ]), None


def examples_of(doc_id: int, text: str) -> Iterator[tuple[str, list[Span]]]:
    """(excerpt, its spans): up to three pieces of personal data, or things like it, side by side between two words of a text; and what looks like it in the text itself without being found by the base patterns, as none."""
    rng = random.Random(f"{SEED} {doc_id} {len(text)}")
    for lo, hi in islice(regions(text, base(text)), EXCERPTS):
        yield text[max(0, lo - 2) : hi + 2], []
    for _ in range(EXCERPTS):
        at = rng.randint(0, len(text))
        before, after = text[max(0, at - AROUND) : at].rpartition(" ")[0], text[at : at + AROUND].partition(" ")[2]
        if any(c.isdigit() or c == "@" for c in before + after):
            before = after = ""
        around = rng.choice([(" ", " "), (" ", " "), (" ", ". "), (" ", ", "), (" (", ") "), (": ", "\n"), ("\n", "\n"), (' "', '" ')])
        part, spans = before + around[0], []
        for k in range(rng.choice([1, 1, 1, 2, 3])):
            part += rng.choice([" ", " ", ", ", "\n", " | "]) if k else ""
            piece, kind = invented(rng)
            if kind:
                spans.append((kind, len(part), len(part) + len(piece)))
            part += piece
        yield part + around[1] + after, spans


def taught(part: str, spans: list[Span]) -> Iterator[tuple[Lattice, list[tuple[int, int, str]]]]:
    """An excerpt's stretches beside its base spans, each with the spans that are to be found there; those that a base span cuts into, or whose own spans cannot be, teach nothing."""
    taken = base(part)
    for lo, hi in regions(part, taken):
        inside = [s for s in spans if s not in taken and s[1] < hi and s[2] > lo]
        lattice = Lattice(part, lo, hi)
        places = [lattice.place(s) for s in inside]
        if lattice.spans and None not in places:
            yield lattice, places


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights of a model trained on made-up personal data in excerpts of at most ``sample`` texts, those of the lowest hash of doc_id, in one task; texts without a doc_id are left out, and of rows that share one the smallest text is taken. Without texts there are no weights, and nothing is added."""
    chosen = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    # One text for each of them, however many rows repeat an id.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))

    def excerpt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, part, written(spans)) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for part, spans in examples_of(i, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "part", "spans"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (x for batch in batches for x in zip(batch["part"].to_pylist(), batch["spans"].to_pylist(), strict=True))
        weights = train([x for part, spans in pairs for x in taught(part, read(spans))])
        yield pa.RecordBatch.from_arrays([pa.array(list(weights), pa.string()), pa.array(list(weights.values()), pa.float64())], ["feature", "weight"])

    with short_batches(docs.sparkSession):
        excerpts = picked.mapInArrow(excerpt, "doc_id long, part string, spans string")
        got = excerpts.repartition(1).sortWithinPartitions("doc_id", "part", "spans").mapInArrow(learn, "feature string, weight double").collect()
    return {r["feature"]: r["weight"] for r in got}


def added(text: str, taken: list[Span], model: Model) -> list[Span]:
    """What the model finds outside the base spans."""
    out = []
    for lo, hi in regions(text, taken):
        at = tokens(text, lo, hi)
        out += [(kind, at[i][0], at[j - 1][1]) for i, j, kind in model.best(text, at)]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def read(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def find_personal(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with ``base_spans``, ``spans`` (kind:start:end, joined by commas, by start, then kind: email, ip, card, phone; code points, end exclusive) and ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``n_added`` (base spans of each kind; what the model adds).

    Base spans are the leftmost non-overlapping matches of a pattern for each kind, those dropped that do not hold (parts of an ip over 255; cards of other than 12 to 19 digits, or whose check sum is wrong; phones of other than 9 to 15 digits). Between them the model chooses spans that overlap neither them nor each other: boundaries and kinds together, by the best sum over whole spans. Spans that it adds have at most ``LONGEST`` tokens, ``WIDEST`` code points and ``DIGITS`` digits. Texts are searched whole and may be of any length. Null and empty texts have no spans; rows that repeat are judged alike; an empty table gives no rows. Columns of ``docs`` with the names added are replaced; other names are free.
    """
    names = ("base_spans", "spans", *(f"n_{k}" for k in KINDS), "n_added")
    rows = carried(docs, names)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    number = {n: "long" for n in names[2:]}

    @F.pandas_udf(f"base_spans string, spans string, {', '.join(f'{n} {t}' for n, t in number.items())}")
    def find(texts):
        import pandas as pd

        own, out = Model(model.value), []
        for text in texts.tolist():
            taken = base(text or "")
            more = added(text or "", taken, own)
            out.append((written(taken), written([*taken, *more]), *(sum(s[0] == k for s in taken) for k in KINDS), len(more)))
        return pd.DataFrame(out, columns=list(names))

    out = rows.withColumn("found", find("in_text"))
    return released(out, **{n: F.col(f"found.{n}") for n in names})


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; cases as in ``find_personal``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")
