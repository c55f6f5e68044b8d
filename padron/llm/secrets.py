"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags words as begin, inside or outside of a secret. Its features are the word's own
shape, the classes of two words before and one after, and how much of the whole text is unlike
prose. It is trained here, by likelihood, on a bounded sample: windows of words from documents
chosen by a hash of the id, some with a generated secret or a generated harmless number put in,
tagged by construction and by the fixed patterns.

Decoding is exact Viterbi, made only where a tag other than "outside" can win. ``slack`` is by
how much any transition can beat staying outside. A word whose margin for "outside" is over
twice the slack is cold; a secret must hold a word that is not. Around those, words are decoded
until the margins given up exceed all that the text's warm words can gain, so every cut is at a
word that is outside on the best path.

Defined results: a null or empty text has no spans. Each row gives one row, repeated or not.
Offsets are code points, ends exclusive. Spans of the field that touch one of the patterns are
left out. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padron.llm.words import WordMemory, as_text, with_key

# The patterns of the base scan.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "field")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Documents whose windows the field is trained on, and words of a window.
SAMPLE_DOCS, WINDOW = 500, 24
#: Windows about secrets that one sampled document gives, drawn from all of its secrets.
SPANS = 4
ROUNDS, RATE, DECAY = 100, 0.2, 1e-3
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns."""
    found = []
    lowered = data.lower()
    if any(name in lowered for name in _NAMES):
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= 6:
                found.append((m.start(), m.end(), 0))
    if b"AKIA" in data:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


# Features

# Words that announce a secret.
_HINTS = (
    "password passwd pwd pass secret token apikey api_key key access_key private_key"
    " client_secret credential auth authorization bearer login"
).split()
_HINT_OF = {h.encode(): h for h in _HINTS}
_EDGE = b"\"'`.,;:!?()[]{}<>#*$%&|="
_VALUE = re.compile(rb"^[\"'`(]*[A-Za-z_\-]*[\"']?(?:=|:)[\"']?")


def _class(word: bytes) -> str:
    """What a neighbour sees of a word."""
    core = word.strip(_EDGE).lower()
    if not core:
        return "=" if word in (b"=", b":", b"=>", b":=") else "marks"
    if core in _HINT_OF:
        return "hint=" if word[-1:] in b"=:" else "hint"
    if core.isalpha() or not core.isascii():
        return "word"
    return "digits" if core.isdigit() else "mixed"


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def _own(word: bytes) -> tuple[str, ...]:
    """Features of the word itself."""
    head = _VALUE.match(word)
    name = word[: head.end()].lower().strip(_EDGE) if head else b""
    value = (word[head.end() :] if head else word).strip(b"\"'`.,;:!?()[]{}<>#*$%&|")
    seen = ("b", "n=" + (_HINT_OF.get(name) and "hint" or ("other" if name else "none")))
    size = len(value)
    if not size or value.isalpha() or not value.isascii():
        return (*seen, f"plain{_level(size, (1, 8, 14, 20, 30))}")
    digits = sum(48 <= b <= 57 for b in value)
    upper = sum(65 <= b <= 90 for b in value)
    lower = sum(97 <= b <= 122 for b in value)
    marks = size - digits - upper - lower
    changes = sum(
        (48 <= a <= 57) != (48 <= b <= 57) for a, b in zip(value, value[1:], strict=False)
    )
    times = np.bincount(np.frombuffer(value, np.uint8))
    share = times[times > 0] / size
    spread = float(-(share * np.log2(share)).sum())
    kinds = ("9" if digits else "") + ("X" if upper else "") + ("x" if lower else "") + ("-" if marks else "")
    return (
        *seen,
        "k" + kinds,
        f"l{_level(size, (4, 6, 8, 12, 16, 20, 28, 40))}",
        f"k{kinds}l{_level(size, (6, 12, 20, 32))}",
        f"d{_level(digits / size, (0.1, 0.3, 0.6, 0.99))}",
        f"c{_level(changes, (1, 2, 4, 8))}",
        f"s{_level(spread, (1.5, 2.2, 2.8, 3.2, 3.8))}",
        f"m{_level(marks / size, (0.01, 0.15, 0.3))}",
        "mail" if b"@" in value else "nomail",
        "dots" if value.count(b".") >= 2 else "nodots",
        "path" if b"/" in value and b"//" in value else "nopath",
    )


def _odd(own: tuple[str, ...]) -> bool:
    return not own[2].startswith("plain")


def _file(odd_share: float) -> str:
    return f"f{_level(odd_share, (0.001, 0.01, 0.05, 0.2))}"


@dataclass
class Field:
    """Weights of features and transitions."""

    names: dict[str, int]
    weights: np.ndarray  # one row a feature, one column a tag
    moves: np.ndarray  # from, to
    start: np.ndarray
    slack: float = field(init=False)

    def __post_init__(self) -> None:
        stay = self.moves[OUT, OUT]
        self.slack = float(max(0.0, self.moves.max() - stay, (self.start - self.start[OUT]).max()))

    def of(self, *names: str) -> np.ndarray:
        places = [self.names[n] for n in names if n in self.names]
        return self.weights[places].sum(0) if places else np.zeros(3)


def window_features(found: list[bytes], file: str) -> list[list[str]]:
    """Names of features of each word of a short sequence."""
    kinds = ["edge", "edge", *map(_class, found), "edge"]
    return [
        [*_own(w), f"p{kinds[i + 1]}", f"q{kinds[i]}", f"r{kinds[i + 3]}", file]
        for i, w in enumerate(found)
    ]


# Training

# Harmless things that look odd, as formats of digits (9) and letters (a).
_HARMLESS = ["9999999999999999", "aaa.99@aaaa9.example.com", "(999) 999-9999", "99.999.99.999", "9999-99-99", "v9.99.9", "https://aaaa.example.com/aaa/99", "$9,999.99", "99:99:99", "A9", "999-9999", "aaaa_aaaa", "9.9", "99%"]
_FORMS = ["{n} = \"{v}\"", "{n}: {v}", "{n}={v}", "{n}='{v}'", "{n} = {v}", "\"{n}\": \"{v}\",", "{n} is {v}", "Authorization: Bearer {v}", "{v}", "{n} := {v}", "--{n} {v}"]


def _secret(rng: random.Random) -> str:
    kind = rng.randrange(6)
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    if kind == 0:
        value = draw(hexa, rng.choice([24, 32, 40, 64]))
        return value.upper() if rng.random() < 0.3 else value
    if kind == 1:
        return draw(mixed + "+/", rng.choice([20, 32, 44])) + "=" * rng.randrange(2)
    if kind == 2:
        return "AKIA" + draw(mixed[:26] + "0123456789", 16)
    if kind == 3:
        return rng.choice(["sk-", "ghp_", "xoxb-", "glpat-"]) + draw(mixed, rng.choice([20, 36]))
    if kind == 4:
        return draw(mixed, rng.randint(12, 24))
    return draw(mixed[26:52], rng.randint(3, 6)) + draw("0123456789", rng.randint(2, 4)) + draw(mixed, 3)


def _filled(form: str, rng: random.Random) -> str:
    return "".join(
        rng.choice("0123456789") if c == "9" else rng.choice("abcdefghijklmnop") if c == "a" else c
        for c in form
    )


def training_windows(key: str, text: str | None) -> list[tuple[list[bytes], list[int], str]]:
    """Tagged windows of one document; the same for the same id and text."""
    rng = random.Random(f"{key}:{len(text or '')}")
    text = text or ""
    marks = list(_WORD.finditer(text))
    odd = sum(_odd(_own(m.group().encode("utf-8", "surrogatepass"))) for m in marks)
    file = _file(odd / max(1, len(marks)))
    spans = base_spans(text, text.encode("utf-8", "surrogatepass"))
    values = [(ASSIGN.match(text, a).start(2) if k == 0 else a, b) for a, b, k in spans]
    tags = [OUT] * len(marks)
    starts = [m.start() for m in marks]
    for a, b in values:
        first = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        for at in range(first, len(marks)):
            if starts[at] >= b:
                break
            tags[at] = BEGIN if at == first else INSIDE
    found = [m.group().encode("utf-8", "surrogatepass") for m in marks]
    places = [i for i, t in enumerate(tags) if t == BEGIN]
    places = rng.sample(places, min(SPANS, len(places)))
    places += [rng.randrange(len(found)) for _ in range(2) if found]
    out = []
    for at in places:
        a = max(0, at - rng.randrange(4, WINDOW - 4))
        out.append((found[a : a + WINDOW], tags[a : a + WINDOW], file))
    words, own = (out[-1][0], out[-1][1]) if out else ([], [])
    for harmless in (False, False, True):
        at = rng.randrange(len(words) + 1)
        if harmless:
            new = [w.encode() for w in _filled(rng.choice(_HARMLESS), rng).split()]
            new_tags = [OUT] * len(new)
            if rng.random() < 0.3:  # a hint alone is no secret
                new, new_tags = [rng.choice(_HINTS).encode(), *new], [OUT, *new_tags]
        else:
            value = _secret(rng)
            new = rng.choice(_FORMS).format(n=rng.choice(_HINTS), v=value).split()
            new_tags = [BEGIN if value in w else OUT for w in new]
            new = [w.encode() for w in new]
        out.append(
            (words[:at] + new + words[at:], own[:at] + new_tags + own[at:], _file(rng.choice([0.0, 0.005, 0.02, 0.1])) if rng.random() < 0.5 else file)
        )
    return [w for w in out if w[0]]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fitted(windows: list[tuple[list[bytes], list[int], str]]) -> Field:
    """Maximum likelihood with a penalty on large weights; forward and backward sums."""
    names: dict[str, int] = {}
    seqs = [
        [[names.setdefault(f, len(names)) for f in fs] for fs in window_features(w, file)]
        for w, _, file in windows
    ]
    n, steps = len(seqs), max(map(len, seqs))
    lengths = np.array([len(s) for s in seqs])
    flat = [f for s in seqs for fs in s for f in fs]
    row = np.repeat(
        [i * steps + t for i, s in enumerate(seqs) for t in range(len(s))],
        [len(fs) for s in seqs for fs in s],
    )
    flat = np.array(flat)
    tags = np.zeros((n, steps), int)
    for i, (_, own, _) in enumerate(windows):
        tags[i, : len(own)] = own
    live = np.arange(steps)[None] < lengths[:, None]
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order], prepend=-1))
    row_cuts = np.flatnonzero(np.diff(row, prepend=-1))
    weights, moves, start = np.zeros((len(names), 3)), np.zeros((3, 3)), np.zeros(3)
    slow = [np.full_like(x, 1e-8) for x in (weights, moves, start)]
    truth = np.eye(3)[tags] * live[..., None]
    true_moves = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    for _ in range(ROUNDS):
        score = np.zeros((n * steps, 3))
        score[row[row_cuts]] = np.add.reduceat(weights[flat], row_cuts)
        score = score.reshape(n, steps, 3)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, steps):
            new = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
            ahead[:, t] = np.where(live[:, t, None], new, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = _log_sum(moves[None] + (score[:, t + 1] + behind[:, t + 1])[:, None], 2)
            behind[:, t] = np.where(live[:, t + 1, None], new, 0)
        whole = _log_sum(ahead[:, -1], 1)[:, None, None]
        p = np.exp(ahead + behind - whole) * live[..., None]
        pair = np.exp(
            ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - whole[..., None]
        ) * live[:, 1:, None, None]
        error = (truth - p).reshape(-1, 3)
        grads = (
            np.add.reduceat(error[row[order]], cuts) / n - DECAY * weights,
            (true_moves - pair.sum((0, 1))) / n - DECAY * moves,
            (truth[:, 0] - p[:, 0]).sum(0) / n - DECAY * start,
        )
        for x, g, s in zip((weights, moves, start), grads, slow, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Field(names, weights, moves, start)


# Decoding


class Tagger:
    """Tags whole texts; remembers the kind of each word it has met."""

    def __init__(self, model: Field) -> None:
        self.model = model
        self.kinds: dict[tuple, int] = {}
        self.own, self.classes, self.odd = np.zeros((0, 3)), np.zeros(0, int), np.zeros(0, bool)
        self.class_of: dict[str, int] = {"edge": 0}
        self._rows: list[tuple] = []
        self.memory = WordMemory(self._kind)
        self._sides()

    def _sides(self) -> None:
        """Scores that a neighbour's class adds."""
        names = list(self.class_of)
        self.sides = [np.array([self.model.of(side + c) for c in names]) for side in "pqr"]

    def _kind(self, word: bytes) -> int:
        own, side = _own(word), _class(word)
        found = self.kinds.get((own, side))
        if found is None:
            found = self.kinds[own, side] = len(self._rows)
            place = self.class_of.setdefault(side, len(self.class_of))
            self._rows.append((self.model.of(*own), place, _odd(own)))
        return found

    def _tables(self) -> None:
        if len(self.own) < len(self._rows):
            self.own = np.array([r[0] for r in self._rows])
            self.classes = np.array([r[1] for r in self._rows])
            self.odd = np.array([r[2] for r in self._rows])
            if len(self.sides[0]) < len(self.class_of):
                self._sides()

    def tags(self, found: list[bytes]) -> np.ndarray | None:
        """Tags of the words, or nothing if all are outside."""
        n = len(found)
        if not n:
            return None
        kind = np.fromiter(map(self.memory.__getitem__, found), np.int64, n)
        self._tables()
        side = np.concatenate([[0, 0], self.classes[kind], [0]])
        p, q, r = self.sides
        score = self.own[kind] + p[side[1:-2]] + q[side[:-3]] + r[side[3:]]
        score += self.model.of(_file(float(self.odd[kind].mean())))
        gain = np.maximum(score[:, BEGIN], score[:, INSIDE]) - score[:, OUT] + 2 * self.model.slack
        warm = np.flatnonzero(gain > 0)
        if not len(warm):
            return None
        most = gain[warm].sum()
        cost = np.cumsum(np.maximum(-gain, 0))
        left = np.searchsorted(cost, cost[warm] - most, "left")
        right = np.searchsorted(cost, cost[warm] + most, "right") + 1
        tags, at = np.zeros(n, np.int8), 0
        while at < len(warm):
            a, b = int(left[at]), int(min(right[at], n))
            while at + 1 < len(warm) and left[at + 1] <= b:
                at += 1
                b = int(min(max(b, right[at]), n))
            tags[a:b] = viterbi(score[a:b], self.model, a == 0, b == n)
            at += 1
        return tags if tags.any() else None


def viterbi(score: np.ndarray, model: Field, first: bool, last: bool) -> list[int]:
    """The best tags; beyond ends that are not the text's own lies an outside word."""
    moves = model.moves.tolist()
    best = (score[0] + (model.start if first else model.moves[OUT])).tolist()
    back = []
    for own in score[1:].tolist():
        new, origin = [], []
        for to in range(3):
            options = [best[k] + moves[k][to] for k in range(3)]
            top = max(options)
            new.append(top + own[to])
            origin.append(options.index(top))
        best = new
        back.append(origin)
    if not last:
        best = [b + moves[k][OUT] for k, b in enumerate(best)]
    tag = best.index(max(best))
    out = [tag]
    for origin in reversed(back):
        tag = origin[tag]
        out.append(tag)
    return out[::-1]


_HEAD = re.compile(r"^[\"'`(]*(?:[A-Za-z_\-]*[\"']?(?:=|:)[\"']?)?")


def field_spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Spans of values: names, quotes and marks around a value are no part of it."""
    marks = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    while at < len(tags):
        if tags[at] == OUT:
            at += 1
            continue
        end = at + 1
        while end < len(tags) and tags[end] == INSIDE:
            end += 1
        a, b = marks[at][0], marks[end - 1][1]
        piece = text[a:b]
        a += _HEAD.match(piece).end()
        b -= len(piece) - len(piece.rstrip("\"'`.,;:!?()[]{}<>#*$%&|"))
        if b - a >= 6:
            out.append((a, b))
        at = end
    return out


def scan(text: str | None, tagger: Tagger) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind number) by start, then kind."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, data)
    tags = tagger.tags(data.split())
    if tags is None:
        return base
    own = [
        (a, b, 3) for a, b in field_spans(text, tags) if all(b <= x or y <= a for x, y, _ in base)
    ]
    return sorted(base + own, key=lambda s: (s[0], s[2]))


def trained(df: DataFrame, key: str = "doc_id", text: str = "text", docs: int = SAMPLE_DOCS) -> Field:
    """A field trained on windows of about ``docs`` documents, chosen by a hash of the id."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    n = max(1, rows.count())
    # A hash of the id picks the sample; the limit is a bound on top of it.
    share = min(1.0, docs / n)
    chosen = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(1 << 30)) < int(share * (1 << 30))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [
                (k or "", i, b" ".join(w), t, f)
                for k, x in zip(batch["key"], batch["text"], strict=True)
                for i, (w, t, f) in enumerate(training_windows(k or "", x))
            ]
            yield pd.DataFrame(made, columns=["key", "i", "words", "tags", "file"])

    found = (
        rows.where(chosen)
        .limit(2 * docs)
        .mapInPandas(run, "key string, i int, words binary, tags array<int>, file string")
        .toPandas()
        .sort_values(["key", "i"])
    )
    windows = [
        (w.split(b" "), list(t), f)
        for w, t, f in zip(found["words"], found["tags"], found["file"], strict=True)
    ]
    if not windows:  # an empty table still gets a field, from generated windows
        windows = [w for i in range(50) for w in training_windows(str(i), None)]
    return fitted(windows)


def report(df: DataFrame, key: str = "doc_id", text: str = "text", model: Field | None = None) -> DataFrame:
    """Per row: id, numbers of base spans by kind, their digest, all spans."""
    model = model or trained(df, key, text)

    def listed(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for batch in batches:
            rows = []
            for x in batch["text"]:
                spans = scan(x, tagger)
                base = [s for s in spans if s[2] < 3]
                number = [sum(s[2] == k for s in base) for k in range(3)]
                rows.append((*number, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "key", batch["key"].array)
            yield out

    rows = df.select(as_text(key), F.col(text).alias("text"))
    shape = "key string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return with_key(rows.mapInPandas(run, shape), key, df.schema[key].dataType)
