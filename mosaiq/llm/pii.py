"""Personal data by base patterns and a semi-Markov conditional random field.

Base patterns give emails, IPv4 addresses, card numbers and international phone numbers; their matches always stay. The
field adds what has no fixed form: spelled-out emails, local phone numbers, IPv6 addresses and secrets. Loose shapes
propose candidate segments at token boundaries, those that touch a base span aside; features of a whole segment (lengths and separators of its
groups, digit counts, words in and before it) score it under every type. Dynamic programming over the candidates jointly
chooses which segments are entities, their boundaries and their types; all else is text. Weights are fitted by
likelihood, with the forward-backward sums of the same lattice, on sentences that this module makes up from templates; no
corpus row is used, so the model is the same everywhere.

All base scans are linear in the text's length: possessive patterns take whole runs, and runs are cut into matches.

Defined results: null counts as empty; empty texts have no spans; repeated rows each get a row; null ids are kept; extra
columns are only carried by `redacted`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from mosaiq.llm.common import arrow_map, spread

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_text", "phone_local", "ip_v6", "secret")
KINDS = BASE + ADDED
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
SPACED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        # A run before the next sign can't begin before this one.
        done = max(done, at + 1)
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in DOTTED.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in SPACED.finditer(text):
        if 13 <= run.end() - run.start() <= 37:
            digits = run.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(run.group())) <= 15:
            yield run.span()


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", a, b) for a, b in ips(text)] + [("card", a, b) for a, b in cards(text)]
        out += [("phone", a, b) for a, b in phones(text)] if "+" in text else []
    return out


# The field.

MOST_CHARS, MOST_GROUPS = 96, 6
SHAPES = {
    "dot": re.compile(r"[\w.%+-]{1,48}(?:[ ._-]{0,2}[\[({<]?\s?\b(?:at|AT|At|dot|DOT|Dot)\b\s?[\])}>]?[ ._-]{0,2}[\w-]{1,32}){2,}"),
    "digits": re.compile(r"(?<![\w+])\(?\d{2,6}+(?!\w)\)?(?:[ ./-]{1,2}\(?\d{2,6}+(?!\w)\)?)++"),
    "colons": re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![\w:])"),
    "assigned": re.compile(r"(?<=[=:])\s{0,2}[\"']?(?=[A-Za-z0-9+/_.~=\-]{8})[A-Za-z0-9+/_\-]++(?:[.~=]++[A-Za-z0-9+/_\-]++)*+=*+[\"']?"),
}
GROUP = re.compile(r"\(?(?P<n>\d+)\)?")
DOT = re.compile(r"\b[dD][oO][tT]\b")
COLONS = re.compile(r"[0-9A-Fa-f:]:[0-9A-Fa-f]{1,4}:|::")
ASSIGNED = re.compile(r"(?i)(?:token|passw(?:or)?d|pwd|secret|key|auth)\w{0,8}[\"']?\s{0,2}[=:]")
TOKEN = re.compile(r"[A-Za-z_]+|[0-9]+|[^\sA-Za-z0-9_]")
WORD_BEFORE = re.compile(r"([A-Za-z]{1,16})\W{0,3}$")
CUES = {"tel": "call", "phone": "call", "call": "call", "fax": "call", "mobile": "call", "cell": "call", "ring": "call", "mail": "mail", "email": "mail", "write": "mail", "contact": "mail", "ip": "net", "host": "net", "address": "net", "server": "net", "token": "key", "password": "key", "passwd": "key", "pwd": "key", "secret": "key", "key": "key", "auth": "key", "version": "no", "order": "no", "page": "no", "date": "no", "total": "no", "isbn": "no", "score": "no", "time": "no", "on": "no", "of": "no", "ratio": "no", "id": "no"}


def proposals(text: str) -> list[tuple[int, int]]:
    """Candidate segments. Of a run of numbers, all that hold 2 to MOST_GROUPS of them; of a spelled-out area, all that begin
    and end at tokens, up to MOST_CHARS; of a colon chain or an assigned value, the whole and its parts that begin or end up to
    three tokens further in. Areas have any length."""
    out = set()
    if DIGIT.search(text):
        for m in SHAPES["digits"].finditer(text):
            # Starts and ends of each group, without and with its bracket.
            groups = [({g.start(), g.start("n")}, {g.end("n"), g.end()}) for g in GROUP.finditer(text, *m.span())]
            for k, (starts, _) in enumerate(groups):
                out.update((x, y) for _, ends in groups[k + 1 : k + MOST_GROUPS] for x in starts for y in ends)
    for a, b in areas(text, DOT, "dot", MOST_CHARS):
        tokens = [t.span() for t in TOKEN.finditer(text, a, b)]
        for k, (x, _) in enumerate(tokens):
            for _, y in tokens[k:]:
                if y - x > MOST_CHARS:
                    break
                out.add((x, y))
    values = []
    done = 0
    for m in ASSIGNED.finditer(text):
        if m.start() >= done:
            # A value that begins near the mark is taken to its end.
            begins = [x.start() for x in SHAPES["assigned"].finditer(text, m.start(), m.end() + 80)]
            spans = [SHAPES["assigned"].match(text, x).span() for x in begins]
            values += spans
            done = max((e for _, e in spans), default=done)
    for a, b in {*areas(text, COLONS, "colons", 48), *values}:
        tokens = [t.span() for t in TOKEN.finditer(text, a, b)]
        for s in tokens[:4]:
            out.update((s[0], e[1]) for e in tokens[-4:] if s[0] < e[1])
    return sorted(out)


def areas(text: str, mark: re.Pattern, shape: str, reach: int) -> list[tuple[int, int]]:
    """Matches of a shape within reach of a mark; windows that touch are searched as one."""
    near: list[list[int]] = []
    for m in mark.finditer(text):
        low, high = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if near and low <= near[-1][1]:
            near[-1][1] = high
        else:
            near.append([low, high])
    return [x.span() for low, high in near for x in SHAPES[shape].finditer(text, low, high)]


def features(text: str, a: int, b: int) -> list[str]:
    """Of a whole segment; each is used with each type."""
    span = text[a:b]
    tokens = TOKEN.findall(span)
    numbers = [t for t in tokens if t[0].isdigit()]
    digits = sum(map(len, numbers))
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    lower = [t.lower() for t in tokens]
    before = WORD_BEFORE.search(text[max(0, a - 24) : a])
    cue = CUES.get(before.group(1).lower(), "other") if before else "none"
    shape = "-".join(str(min(len(t), 9)) for t in numbers) if len(numbers) == sum(t.isalnum() for t in tokens) else "words"
    out = ["bias", f"marks={marks}", f"digits={min(digits, 20)}", f"groups={min(len(numbers), 9)}", f"shape={shape}", f"cue={cue}", f"first={kind_of(tokens[0])}", f"last={kind_of(tokens[-1])}", f"tokens={min(len(tokens), 12)}"]
    out += [f"has={w}" for w in ("at", "dot") if w in lower]
    out += [f"n_at={min(lower.count('at'), 2)}", f"colons={min(span.count(':'), 8)}", f"prev={text[a - 1 : a] if a and not text[a - 1].isalnum() else '_'}", f"next={text[b : b + 1] if not text[b : b + 1].isalnum() else '_'}"]
    if len(span) >= 8 and " " not in span:
        mixed = sum(c.isdigit() for c in span) * 10 // len(span)
        out += [f"mixed={mixed}", f"long={min(len(span) // 8, 6)}", f"cue={cue}&solid"]
    if lower[-1] in {"com", "org", "net", "edu", "de", "fr", "es", "io", "info", "uk"}:
        out.append("tld")
    return out


def kind_of(token: str) -> str:
    return f"d{min(len(token), 5)}" if token[0].isdigit() else ("w" if token[0].isalpha() else token[0])


def lattice(text: str, base: list[Span] = ()) -> list[tuple[int, int, list[str]]]:
    """Candidate segments with their features, by end. The base spans are decided already: no segment touches one."""
    ends, starts = [], []
    for _, a, b in sorted(base, key=lambda s: (s[1], s[2])):
        # Overlapping spans make up one taken range.
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k == len(ends) or starts[k] >= b

    return sorted(((a, b, features(text, a, b)) for a, b in proposals(text) if free(a, b)), key=lambda x: (x[1], x[0]))


def decode(text: str, weights: dict, base: list[Span] = ()) -> list[Span]:
    """The best set of non-overlapping typed segments beside the base spans: one pass over ends, in order. No segment scores 0."""
    cells = lattice(text, base)
    ends = [0]
    best: list[tuple[float, int, Span | None]] = [(0.0, 0, None)]  # per end: score, index of the state before, segment
    for a, b, f in cells:
        kind, score = max(((k, sum(weights.get((k, x), 0.0) for x in f)) for k in ADDED), key=lambda x: x[1])
        before = index_at(ends, a)
        total = best[before][0] + score
        last = best[-1]
        if ends[-1] != b:
            ends.append(b)
            best.append((last[0], len(best) - 1, None))
        if total > best[-1][0]:
            best[-1] = (total, before, (kind, a, b))
    out, k = [], len(best) - 1
    while k:
        _, before, span = best[k]
        if span:
            out.append(span)
        k = before
    return out[::-1]


def index_at(ends: list[int], a: int) -> int:
    """The last end that is not after a."""
    low, high = 0, len(ends) - 1
    while low < high:
        mid = (low + high + 1) // 2
        if ends[mid] <= a:
            low = mid
        else:
            high = mid - 1
    return low


def log_add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def gradient(cells: list, gold: set, weights: dict) -> Counter:
    """Observed minus expected counts of features: forward and backward sums over all sets of non-overlapping typed segments."""
    scores = [[sum(weights.get((k, x), 0.0) for x in f) for k in ADDED] for _, _, f in cells]
    points = sorted({0, *(x for a, b, _ in cells for x in (a, b))})
    place = {p: k for k, p in enumerate(points)}
    ahead, back = [0.0] * len(points), [0.0] * len(points)
    into, outof = {}, {}
    for c, (a, b, _) in enumerate(cells):
        into.setdefault(place[b], []).append(c)
        outof.setdefault(place[a], []).append(c)
    for k in range(1, len(points)):
        ahead[k] = ahead[k - 1]
        for c in into.get(k, ()):
            for s in scores[c]:
                ahead[k] = log_add(ahead[k], ahead[place[cells[c][0]]] + s)
    for k in range(len(points) - 2, -1, -1):
        back[k] = back[k + 1]
        for c in outof.get(k, ()):
            for s in scores[c]:
                back[k] = log_add(back[k], back[place[cells[c][1]]] + s)
    out: Counter = Counter()
    for c, (a, b, f) in enumerate(cells):
        for k, s in zip(ADDED, scores[c], strict=True):
            p = math.exp(min(0.0, ahead[place[a]] + s + back[place[b]] - ahead[-1]))
            step = ((k, a, b) in gold) - p
            if abs(step) > 1e-4:
                for x in f:
                    out[k, x] += step
    return out


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with marked entities, and look-alikes that are none."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    u = lambda k: "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    w = lambda: "".join(rng.choice("bcdfghklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    tld = lambda: rng.choice(["com", "org", "net", "edu", "de", "io", "info"])

    def mail() -> str:
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" AT ", " DOT "), ("[at]", "[dot]")])
        return w() + rng.choice(["", "." + w(), d(2)]) + at + w() + rng.choice(["", dot + w()]) + dot + tld()

    def phone() -> str:
        s = rng.choice(["-", " ", "."])
        return rng.choice([f"({d(3)}) {d(3)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"1-{d(3)}-{d(3)}-{d(4)}"[2:]])

    def ip6() -> str:
        return rng.choice([":".join(h(rng.randint(1, 4)) for _ in range(8)), f"{h(4)}:{h(3)}::{h(4)}:{h(2)}", f"fe80::{h(4)}:{h(4)}:{h(4)}", f"2001:db8::{h(4)}:{h(1)}"])

    def secret() -> str:
        return rng.choice([h(16), h(20), h(32), h(40), "AKIA" + u(16), u(20), w().title() + d(4) + w() + d(3), "ghp_" + h(30), "sk-" + h(24), f"ey{h(12)}.ey{h(16)}.{h(20)}", h(22) + "=="])

    def nothing() -> str:
        return rng.choice([
            f"{d(4)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 23)}:{d(2)}:{d(2)}", f"pages {d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"version {d(2)}.{d(2)}.{d(2)}", f"look at {w()} dot {w()} at", f"the dot at {w()}", f"{d(3)} {d(3)} units", f"order {d(5)}-{d(2)}",
            f"ISBN {d(3)}-{d(2)}-{d(5)}", f"{d(2)} 000 000", f"score: {d(2)}-{d(2)}", f"key: {w()} {w()}", f"author: www.{w()}{w()}.{tld()}", f"key: {w()}{w()}{w()}{w()}{w()}", f"key={w()}.{w()}.{w()}", f"ratio {d(2)}:{d(2)}:{d(2)}", f"password: {w()}{w()}{w()}{w()} is", f"id {d(4)} {d(4)}", f"{d(4)}-{d(4)}", f"a dot {w()} dot {w()}", f"{d(2)}.{d(2)}.{d(4)}", f"in {d(4)}/{d(2)}", f"x = {w()}{w()}{w()}{w()}{w()}",
        ])

    makers = {"mail_text": (mail, ["mail ", "write to ", "contact: ", ""]), "phone_local": (phone, ["call ", "phone: ", "tel. ", "fax ", ""]), "ip_v6": (ip6, ["host ", "from ", "address ", ""]), "secret": (secret, ['token = "', "password=", "secret: ", 'api_key = "', "auth_token=", "my key: ", "key: ", "key=", "password: "])}
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(w() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ", ", ". ", ": "])
            if rng.random() < 0.5:
                kind = rng.choice(ADDED)
                make, cues = makers[kind]
                cue, body = rng.choice(cues), make()
                text += cue
                gold.append((kind, len(text), len(text) + len(body)))
                text += body + ('"' if cue.endswith('"') else "") + rng.choice([" ", ", ", ". ", "; "])
            else:
                text += nothing() + " "
        out.append((text + w(), gold))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 1500, rounds: int = 4, rate: float = 0.25, shrink: float = 1e-4) -> dict:
    """Weights by (type, feature): AdaGrad on the likelihood of the made-up sentences. Takes seconds, on the driver, once."""
    # Features come back again and again; each is kept once.
    rows = [([(a, b, [*map(sys.intern, f)]) for a, b, f in cells], set(gold)) for text, gold in examples(n, seed=7) if (cells := lattice(text))]
    weights: dict = {}
    squares: dict = {}
    for _ in range(rounds):
        for cells, gold in rows:
            for key, g in gradient(cells, gold, weights).items():
                g -= shrink * weights.get(key, 0.0)
                squares[key] = squares.get(key, 1e-6) + g * g
                weights[key] = weights.get(key, 0.0) + rate * g / math.sqrt(squares[key])
    return {k: round(v, 6) for k, v in weights.items() if abs(v) > 1e-3}


def spans_of(text: str, weights: dict) -> tuple[list[Span], list[Span]]:
    """(base, added): the base spans, and the best segments of what they leave."""
    base = base_spans(text)
    if not (DIGIT.search(text) or DOT.search(text) or COLONS.search(text) or ASSIGNED.search(text)):
        return base, []
    return base, sorted(decode(text, weights, base), key=lambda s: (ADDED.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its type in brackets; spans that overlap are replaced as one, by the first's type."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts per kind, base_sha256, spans (base and added) and n_added of each row."""
    weights = trained()

    def run(batch: pa.RecordBatch):
        rows = []
        for text in batch.column(1).to_pylist():
            base, added = spans_of(text or "", weights)
            n = Counter(k for k, _, _ in base)
            rows.append((*(n[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return arrow_map(spread(docs.select(id_col, text_col)), run, f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, personal data in the text replaced by types. Null texts stay null."""
    weights, at = trained(), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch):
        texts = []
        for text in batch.column(at).to_pylist():
            found = [s for part in spans_of(text, weights) for s in part] if text else []
            texts.append(masked(text, found) if found else text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return arrow_map(spread(docs), run, docs.schema)
