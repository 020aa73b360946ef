"""Operator 7: personal data.  Base patterns plus a character-level bidirectional LSTM-CRF that adds spans they miss.

The tagger is trained in numpy on labelled spans: at most CHUNKS stretches of the documents (the first by a hash of id and place; the
bound is a parameter) with their base spans, and each once more with a span in another notation: one of its own rewritten, or a
generated one put in, often behind the name of its kind.  What looks like a datum that nothing labels is left out of training.

The tagger reads a text in overlapping windows at every multiple of STRIDE; each character takes its tag from the window in which it is
nearest to the middle, and spans are read off the joined tags of the whole text.  An added span must, with its written-out signs
replaced, pass the check of its kind (digit count, Luhn, parts of at most 255), touch no base span and lie within REACH words of a tagged
run.  Windows that cannot change this are not decoded: `anchors` has a place of every span that could pass the check, all words within
REACH of it are decoded, and runs that leave them are followed to their ends.  The spans are those of a decoding of every window.

Null texts count as empty ones.  Each row is scanned, repeated ones too, and equal texts have equal spans.  All scans are linear in the
text, which is read whole.  Of overlapping base spans of different kinds all stay.  Empty tables give no rows.  The column named like
the result is replaced, others are kept.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm import tagger
from quipu.llm.common import batched, held_out, read, runs

KINDS = ("email", "ip", "card", "phone")
CHUNKS, CHUNK, WINDOW, AROUND, STEPS = 3000, 160, 64, 32, 700
READ, STRIDE, REACH = 64, 32, 2  # of reading: characters, characters, words
DIGITS = "zero one two three four five six seven eight nine".split()
#: A sign for `at` behind which a label and a dot come: an email that `added_valid` takes has one, and no other `at` up to that dot.
_BESIDE = r"[\s\[\](){}<>]*+"
AT_DOT = rf"(?:@|\b[Aa][Tt]\b){_BESIDE}(?:(?!\b(?:[Aa][Tt]|[Dd][Oo][Tt])\b)[A-Za-z0-9-])++{_BESIDE}(?:\.|\b[Dd][Oo][Tt]\b)"
#: Four digits or more, in signs or words, without a letter between them but those of `dot`: any other kind has them.  Letters beyond
#: ASCII are no hindrance where the class does not list them: more is decoded then, not less.
_UNIT = rf"(?:[0-9]|\b(?i:{'|'.join(DIGITS)})\b)"
_GAP = r"(?:(?i:dot)|[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f\u3131-\u318e\u4e00-\u9fa5])*+"
FOUR_DIGITS = rf"{_UNIT}(?:{_GAP}{_UNIT}){{3,}}+"
ANCHORS = (re.compile(AT_DOT), re.compile(FOUR_DIGITS))
WRITTEN = [(re.compile(r"\s*[\[({<]?\s*\b[Aa][Tt]\b\s*[\])}>]?\s*"), "@"), (re.compile(r"\s*[\[({<]?\s*(?:\b[Dd][Oo][Tt]\b|\.)\s*[\])}>]?\s*"), "."), (re.compile(r"\s*[\[(]?@[\])]?\s*"), "@")]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SIGNS = re.compile("[0-9@]")
_DIGIT = "(?:" + "|".join(f"[{w[0]}{w[0].upper()}]{w[1:]}" for w in DIGITS) + ")"
TRIGGER = re.compile(rf"[0-9@]|\b(?:[Dd]ot|DOT)\b|[\[({{<] ?(?:at|AT) ?[\])}}>]|\b(?:at|AT) [A-Za-z0-9-]+\.[A-Za-z]|\b{_DIGIT}(?:[ ,-]+{_DIGIT}){{2}}\b")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain(kind: str, text: str) -> str:
    """A written-out datum in signs: dots, the at sign, digits."""
    if kind == "email":
        text = re.sub(r"\s+", " ", text)
        for pattern, sign in WRITTEN:
            text = pattern.sub(sign, text)
        return text
    for i, w in enumerate(DIGITS):
        text = re.sub(rf"(?i)\b{w}\b", str(i), text)
    return text


def added_valid(kind: str, text: str) -> bool:
    """Of a span that the tagger finds."""
    signs = plain(kind, text)
    if kind == "email":
        return EMAIL.fullmatch(signs) is not None
    if any(c.isalpha() for c in signs.lower().replace("dot", "")):
        return False
    return valid(kind, signs)


def valid(kind: str, text: str) -> bool:
    if kind == "email":
        left, _, right = text.partition("@")
        return bool(left) and "." in right.strip(".")
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in parts)
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in LOCAL:
            left -= 1
        found = DOMAIN.match(text, at + 1) if left < at else None
        last = found.end() if found else at
        if found:
            out.append(("email", left, last))
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    if not SIGNS.search(text):
        return []
    out = _emails(text)
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \n"
SYMBOLS = 4 + 26 + len(_PUNCTUATION)
TAGS = 1 + 2 * len(KINDS)
_ASCII = np.full(128, 3, np.int64)
_ASCII[48:58], _ASCII[97:123], _ASCII[65:91] = 1, np.arange(4, 30), np.arange(4, 30)
for _i, _c in enumerate(_PUNCTUATION):
    _ASCII[ord(_c)] = 30 + _i


def encode(text: str) -> np.ndarray:
    """Kind of each character: digit, letter beyond ASCII, control, each letter in either case, each punctuation mark; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 2)


def allowed() -> np.ndarray:
    """Transitions: inside follows begin or inside of its kind alone."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = -1e4
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
    return out


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[max(a, 0) : b] = 2 * k + 2
        if a >= 0:
            out[a] = 2 * k + 1
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within AROUND characters of what training learns from: digits, @ and written-out signs."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _rewrite(kind: str, text: str, rng: np.random.Generator) -> str:
    """The same datum in a notation that the base patterns miss."""
    d = _digits(text)
    pick = lambda *forms: forms[int(rng.integers(0, len(forms)))]
    if kind == "phone":
        d = d[-10:].rjust(10, "5")
        parts = [d[:3], d[3:6], d[6:]]
        spelled = pick(" ", ", ", "-").join(DIGITS[int(c)] for c in d)
        return pick(f"({d[:3]}) {d[3:6]}-{d[6:]}", "-".join(parts), ".".join(parts), " ".join(parts), "/".join(parts), f"001 {' '.join(parts)}", spelled, spelled)
    if kind == "card":
        return pick(".", "/", "_", "  ", " - ", ":").join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "ip":
        return text.replace(".", pick("[.]", "(.)", " . ", ",", " dot ", "[dot]", ". "))
    left, _, right = text.partition("@")
    at, dot = pick((" @ ", "."), ("@", "[.]"), ("[@]", "."), ("(@)", "."), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), (" at ", "."))
    return left.replace(".", dot if rng.random() < 0.3 else ".") + at + right.replace(".", dot)


def _luhn_card(rng: np.random.Generator) -> str:
    d = str(rng.integers(4, 6)) + "".join(map(str, rng.integers(0, 10, 14)))
    return d + next(str(c) for c in range(10) if luhn(d + str(c)))


#: What stands before a datum of each kind in running text; the empty name most often.
NAMES = {"email": ["", "", "e-mail ", "mail: ", "contact "], "ip": ["", "", "IP ", "address ", "host "], "card": ["", "", "card ", "card no. ", "visa "], "phone": ["", "", "tel ", "phone: ", "call ", "fax "]}


def _made(rng: np.random.Generator) -> tuple[str, str]:
    """A generated datum of any kind."""
    kind, letters = KINDS[int(rng.integers(0, 4))], "abcdefghijklmnopqrstuvwxyz"
    name = lambda low, high: "".join(letters[i] for i in rng.integers(0, 26, rng.integers(low, high)))
    if kind == "email":
        left = name(3, 10) + (f".{name(2, 8)}" if rng.random() < 0.4 else "") + (str(rng.integers(0, 99)) if rng.random() < 0.4 else "")
        return kind, f"{left}@{name(3, 10)}.{('com', 'org', 'net', 'de', 'fr', 'es', 'io')[int(rng.integers(0, 7))]}"
    if kind == "ip":
        return kind, ".".join(map(str, rng.integers(0, 256, 4)))
    return (kind, _luhn_card(rng)) if kind == "card" else (kind, f"+1 ({rng.integers(200, 999)}) {rng.integers(100, 999)}-{rng.integers(1000, 9999)}")


def _window(body: str, marks: list[Span], around: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A window of body that has place `around` in it; of a span that it cuts, the part inside is labelled as inside or begin."""
    left = int(np.clip(around - rng.integers(0, WINDOW), 0, max(0, len(body) - WINDOW)))
    marks = [(k, x - left, min(y - left, WINDOW)) for k, x, y in marks if y > left and x < left + WINDOW]
    row, tag = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    cut = encode(body[left : left + WINDOW])
    row[: len(cut)], tag[: len(cut)] = cut, tags_of(len(cut), marks)
    return row, tag


#: What could be a datum in another notation: no label says so, hence it must not teach the contrary.
_AT, _DOT = r"(?:\s*[\[({<]\s*(?:at|AT|@)\s*[\])}>]\s*|\s+(?:at|AT)\s+|\s*@\s*)", r"(?:\s*[\[({<]\s*(?:[Dd]ot|DOT|\.)\s*[\])}>]\s*|\s+(?:[Dd]ot|DOT)\s+|\.)"
LOOKALIKES = [
    re.compile(rf"[A-Za-z0-9_+-]+(?:{_DOT}[A-Za-z0-9_+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    re.compile(r"\(?[0-9]+(?:(?:[^A-Za-z0-9]{1,3}|\W{0,2}dot\W{0,2})[0-9]+)+"),
    re.compile(rf"\b{_DIGIT}(?:[ ,-]+{_DIGIT}){{5,}}\b"),
]


def without_lookalikes(body: str) -> str:
    base = base_spans(body)
    found = [(m.start(), m.end()) for p in LOOKALIKES for m in p.finditer(body) if any(added_valid(k, m.group()) for k in KINDS)]
    found = sorted((a, b) for a, b in found if not any(a < y and x < b for _, x, y in base))
    out, last = [], 0
    for a, b in found:
        out.append(body[last : max(a, last)])
        last = max(last, b)
    return "".join([*out, body[last:]])


def training_windows(chunks: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk a window with its base spans, and one with a span rewritten or put in."""
    rng, found = np.random.default_rng(seed), []
    for body in map(without_lookalikes, chunks):
        spans = base_spans(body)
        found.append(_window(body, spans, spans[0][1] if spans else int(rng.integers(0, len(body) + 1)), rng))
        if spans and rng.random() < 0.4:
            kind, x, y = spans[int(rng.integers(0, len(spans)))]
            new, name = _rewrite(kind, body[x:y], rng), ""
        else:
            gaps = [0, *(m.end() for m in re.finditer(r"\s", body))]
            gaps = [g for g in gaps if not any(a <= g <= b for _, a, b in spans)] or [0]
            x = y = gaps[int(rng.integers(0, len(gaps)))]
            kind, datum = _made(rng)
            new, name = _rewrite(kind, datum, rng) if rng.random() < 0.9 else datum, NAMES[kind][int(rng.integers(0, len(NAMES[kind])))]
        tail = ("" if y > x else (" ", ". ", ", ")[int(rng.integers(0, 3))]) + body[y:]
        start = x + len(name)
        whole = body[:x] + name + new + tail
        marks = [(kind, start, start + len(new)), *(s for s in base_spans(whole) if s[2] <= start or s[1] >= start + len(new))]
        found.append(_window(whole, marks, start + len(new) // 2, rng))
    codes, gold = zip(*found, strict=True) if found else ((), ())
    return np.array(codes, np.int64).reshape(-1, WINDOW), np.array(gold, np.int64).reshape(-1, WINDOW)


def train(docs: DataFrame, chunks: int = CHUNKS) -> tagger.Params | None:
    """None where no text has a trigger."""
    cut = F.arrow_udf(_chunks, "array<string>")
    usable = batched(docs).filter(~held_out(F.col("doc_id"), 5) & F.col("text").isNotNull())
    found = usable.select("doc_id", F.posexplode(cut(F.col("text"))).alias("i", "chunk")).orderBy(F.xxhash64("doc_id", "i"), "chunk").limit(chunks)
    codes, gold = training_windows([r.chunk for r in found.select("chunk").collect()])
    return tagger.fit(codes, gold, SYMBOLS, TAGS, embed=12, hidden=24, steps=min(STEPS, 2 * len(codes))) if len(codes) else None


def _chunks(values: pa.Array) -> pa.Array:
    """All stretches around triggers, in pieces."""
    return pa.array([[t[at : min(b, at + CHUNK)] for a, b in regions(t) for at in range(a, b, CHUNK)] for t in values.to_pylist()], pa.list_(pa.string()))


def anchors(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Stretches of which any valid span that touches no base span shares a character."""
    found = [(m.start(), m.start() + 1) for m in ANCHORS[0].finditer(text)] + [(m.start(), m.end()) for m in ANCHORS[1].finditer(text)]
    if not found or not base:
        return found
    first, end = np.array(sorted((a, b) for _, a, b in base)).T
    upto = np.append(0, np.maximum.accumulate(end))
    return [(a, b) for a, b in found if b > upto[np.searchsorted(first, a, "right")]]


def words_of(text: str) -> np.ndarray:
    """First and end of each run without white space."""
    return np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)


def first_windows(text: str, base: list[Span], words: Callable[[], np.ndarray]) -> list[int]:
    """The windows of all words within REACH of an anchor."""
    found, last, out = anchors(text, base), _windows(len(text)) - 1, set()
    for a, b in found:
        at = words()
        low = max(0, int(np.searchsorted(at[:, 1], a, "right")) - REACH)
        high = min(len(at), int(np.searchsorted(at[:, 0], b, "left")) + REACH) - 1
        out.update(range(_window_of(int(at[low, 0]), last), _window_of(int(at[high, 1]) - 1, last) + 1))
    return sorted(out)


def _windows(n: int) -> int:
    return len(range(0, max(1, n - READ + STRIDE), STRIDE))


def _window_of(place: int, last: int) -> int:
    """The window in which a place is nearest to the middle."""
    return min(max(0, (place - (READ - STRIDE) // 2) // STRIDE), last)


def added_spans(texts: list[str], base: list[list[Span]], model: tagger.Params, windows: Callable[[str, list[Span], Callable[[], np.ndarray]], list[int]] = first_windows) -> list[list[Span]]:
    """Spans of the tagged texts that are valid and touch no base span, for each text.  `windows` names those to begin with."""
    out: list[list[Span]] = [[] for _ in texts]
    words = [functools.cache(functools.partial(words_of, t)) for t in texts]
    group: list[tuple[int, int]] = []

    def run() -> None:
        tags = {i: np.zeros(len(texts[i]), np.int8) for i, _ in group}
        asked, done = list(group), set(group)
        while asked:
            cuts = [encode(texts[i][w * STRIDE : w * STRIDE + READ]) for i, w in asked]
            decoded = tagger.decode(model, np.array([np.pad(c, (0, READ - len(c))) for c in cuts]), allowed())
            for (i, w), row in zip(asked, decoded, strict=True):
                a, b = _own(w, len(texts[i]))
                tags[i][a:b] = row[a - w * STRIDE : b - w * STRIDE]
            beside = {(i, v) for i, w in asked for v in _followed(w, tags[i])} - done
            asked = sorted(beside)
            done |= beside
        for i, t in tags.items():  # runs are whole now
            out[i] = _read_off(texts[i], t, base[i], words[i])
        group.clear()

    for i, text in enumerate(texts):
        group += [(i, w) for w in windows(text, base[i], words[i])]
        if len(group) > 500:
            run()
    run()
    return out


def _own(window: int, n: int) -> tuple[int, int]:
    """The characters that take their tags from a window."""
    half = (READ - STRIDE) // 2
    return (window * STRIDE + half if window else 0), (n if window == _windows(n) - 1 else window * STRIDE + STRIDE + half)


def _followed(window: int, tags: np.ndarray) -> list[int]:
    """The windows into which runs of tags of this one may go on."""
    a, b = _own(window, len(tags))
    back = a > 0 and b > a and tags[a] and tags[a] % 2 == 0
    return [window - 1] * bool(back) + [window + 1] * bool(b < len(tags) and tags[b - 1])


def _read_off(text: str, tags: np.ndarray, base: list[Span], words: Callable[[], np.ndarray]) -> list[Span]:
    out: list[Span] = []
    inside = (tags > 0) & (tags % 2 == 0)
    starts = np.flatnonzero((tags > 0) & ~(inside & (np.append(0, tags[:-1]) > 0)))
    tried: dict[tuple[str, int, int], tuple[int, int] | None] = {}
    stops = np.append(np.flatnonzero(~inside), len(tags))
    for i in starts:
        end, kind = int(stops[np.searchsorted(stops, i, "right")]), KINDS[(int(tags[i]) - 1) // 2]
        at = words()
        first, last = int(np.searchsorted(at[:, 1], i, "right")), int(np.searchsorted(at[:, 0], end, "left")) - 1
        if first > last:
            continue
        if (kind, first, last) not in tried:
            tried[kind, first, last] = fitted(kind, text, at, first, last)
        found = tried[kind, first, last]
        if found and not any(found[0] < y and x < found[1] for _, x, y in [*base, *out]):
            out.append((kind, *found))
    return out


def fitted(kind: str, text: str, words: np.ndarray, first: int, last: int) -> tuple[int, int] | None:
    """The valid span of whole words that ends nearest to those of a tagged run: at most REACH words fewer or more at each side."""
    ends = sorted((abs(p) + abs(q), p, q) for p in range(-REACH, REACH + 1) for q in range(-REACH, REACH + 1))
    for _, p, q in ends:
        low, high = first + p, last + q
        if 0 <= low <= high < len(words):
            x, y = int(words[low, 0]), int(words[high, 1])
            while y > x and text[y - 1] in ".,;:!?":
                y -= 1
            if added_valid(kind, text[x:y]):
                return x, y
    return None


def all_spans(texts: list[str | None], model: tagger.Params | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and base and added spans together, by kind and start."""
    plain = [t or "" for t in texts]
    base = [base_spans(t) for t in plain]
    added = added_spans(plain, base, model) if model else [[] for _ in plain]
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return base, [sorted([*b, *a], key=order) for b, a in zip(base, added, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _over_text(docs: DataFrame, out: str, kind: str, make: Callable[[list], pa.Array]) -> DataFrame:
    def run(values: pa.Array) -> pa.Array:
        parts = [make(values.slice(at, length).to_pylist()) for at, length in runs(values)]
        return pa.concat_arrays(parts) if parts else make([])

    return batched(docs).withColumn(out, F.arrow_udf(run, kind)(F.col("text")))


def with_spans(docs: DataFrame, model: tagger.Params | None, out: str = "pii") -> DataFrame:
    """docs and a struct: counts of base spans by kind, digest of the base spans, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def make(texts: list) -> pa.Array:
        base, found = all_spans(texts, shared.value)
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
        return pa.StructArray.from_arrays([*counts, digests, pa.array([joined(f) for f in found], pa.string())], names)

    return _over_text(docs, out, "struct<" + ",".join(f"n_{k}:long" for k in KINDS) + ",base_sha256:string,spans:string>", make)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """Spans replaced by their kind in brackets; overlapping ones are one stretch, named after the first."""
    if not spans:
        return text
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, model: tagger.Params | None) -> DataFrame:
    """docs with personal data replaced in `text`; other columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> pa.Array:
        return pa.array([redact(t, s) for t, s in zip(texts, all_spans(texts, shared.value)[1], strict=True)], pa.string())

    return _over_text(docs, "text", "string", make)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs, train(docs)).select("doc_id", "pii.*")
