"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns find whole addresses and numbers. The field adds what they can't spell: secrets, addresses
written out in words, phone and identity numbers without a plus. It is trained by maximum likelihood on
the small labelled table that ``labelled_rows`` makes, and decoded by Viterbi in numpy over batches of
lines. A line is a sequence; one without a digit, ``@``, ``=`` or a spelt-out dot has nothing to label.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, digest, free_name, table

QUERIES = Queries()

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds, written so that no start is tried twice.
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` with a host behind it, back over the run of local characters."""
    done = 0
    for match in AFTER_AT.finditer(text):
        start = match.start()
        while start > done and text[start - 1] in LOCALS:
            start -= 1
        if start < match.start():
            yield start, match.end()
            done = match.end()


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and _luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind in the order of ``KINDS``, then by start; code points, end exclusive."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    tests: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
        ("ip", IP, lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
        ("card", CARD, _card),
        ("phone", PHONE, lambda s: 8 <= sum(c.isdigit() for c in s) <= 15))
    for kind, pattern, good in tests:
        spans += [(kind, *m.span()) for m in pattern.finditer(text) if good(m[0])]
    return spans


# The field -------------------------------------------------------------------------------------

ADDED = ("secret", "email", "phone", "identity")
STATES = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))
SEQUENCE = re.compile(r"[0-9@=]|\bdot\b|\(at\)|\[at\]", re.I)
TOKEN = re.compile(r"[^\s=:\"'<>,;]+|[=:\"'<>,;]")
CUES = frozenset("token password passwd pwd secret key api apikey api_key access_token bearer auth credential at dot (at) [at] (dot) "
                 "[dot] mail email e-mail contact write phone tel call fax mobile ssn passport iban id version page on in for of".split())


def word_class(word: str) -> tuple[str, ...]:
    """Features of a word by itself: shape, compressed shape, length, mixture, cue words."""
    core = word.strip(".()[]!?")
    shape = re.sub("[A-Z]", "X", re.sub("[a-zà-ÿ]", "x", re.sub("[0-9]", "9", core)))
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits, uppers, letters = (sum(map(f, core)) for f in (str.isdigit, str.isupper, str.isalpha))
    size = len(core)
    hexed = size >= 16 and all(c in "0123456789abcdefABCDEF" for c in core)
    mixed = "mix" if digits and letters else "digits" if digits and digits >= size - 3 else "letters" if letters else "marks"
    lower = word.lower()
    return (f"short={short[:12]}", f"shape={shape if size <= 8 else ''}", f"size={size if size < 6 else min(size // 4 * 4, 24)}",
            f"kind={mixed}", f"mix={mixed}{size >= 10}{uppers > 2}", f"hex={hexed}",
            f"cue={lower if lower in CUES else core.lower() if core.lower() in CUES else ''}", "bias")


# What a labelled span must hold to count.
SPELT = {"email": re.compile(r"\b(?:at|AT)\b.*\b(?:dot|DOT)\b", re.S), "phone": re.compile(r"(?:[0-9][^0-9]*){7}"),
         "identity": re.compile(r"(?:[0-9][^0-9]*){9}"), "secret": re.compile(r"[^\s]{12}")}


class Field:
    """Weights of a linear-chain field; emissions are sums over the classes of a word and its two neighbours."""

    def __init__(self, weights: dict[tuple[int, str], np.ndarray], moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.classes: dict[tuple[str, ...], int] = {}
        self.words: dict[str, int] = {}
        self.rows: list[list[np.ndarray]] = [[np.zeros(len(STATES))] for _ in range(3)]
        self.tables: list[np.ndarray] | None = None

    def number(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 200_000:
                self.words.clear()
            features = word_class(word)
            found = self.classes.get(features)
            if found is None:
                found = self.classes[features] = len(self.classes) + 1
                none = np.zeros(len(STATES))
                for side in range(3):
                    self.rows[side].append(sum((self.weights.get((side, f), none) for f in features), none))
                self.tables = None
            self.words[word] = found
        return found

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Best states of each line of words; lines of like length go through Viterbi together."""
        numbers = [np.array([self.number(w) for w in words], np.int64) for words in lines]
        if self.tables is None:
            self.tables = [np.stack(rows) for rows in self.rows]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lines)
        order = sorted((i for i in range(len(lines)) if len(numbers[i])), key=lambda i: len(numbers[i]))
        while order:
            longest = len(numbers[order[-1]])
            group = order[-max(1, 100_000 // longest):]
            del order[-len(group):]
            padded = np.zeros((len(group), longest + 2), np.int64)
            for row, i in enumerate(group):
                padded[row, 1:len(numbers[i]) + 1] = numbers[i]
            for row, path in zip(group, self._viterbi(padded, np.array([len(numbers[i]) for i in group]))):
                out[row] = path[:len(numbers[row])]
        return out

    def _viterbi(self, padded: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        own, before, after = self.tables
        count, length = len(padded), padded.shape[1] - 2
        best = own[padded[:, 1]] + before[padded[:, 0]] + after[padded[:, 2]] + self.moves[-1]
        back = np.zeros((count, length, len(STATES)), np.int8)
        for t in range(1, length):
            step = best[:, :, None] + self.moves[None, :-1]
            back[:, t] = step.argmax(1)
            emit = own[padded[:, t + 1]] + before[padded[:, t]] + after[padded[:, t + 2]]
            best = np.where((t < sizes)[:, None], step.max(1) + emit, best)
        path, at = np.zeros((count, length), np.int64), best.argmax(1)
        for t in range(length - 1, -1, -1):
            inside = t < sizes
            path[:, t] = np.where(inside, at, 0)
            at = np.where(inside, back[np.arange(count), t, at], at) if t else at
        return path


def labelled_rows(seed: int = 11, copies: int = 8) -> list[list[tuple[str, str]]]:
    """The labelled table: words and states of lines made from the forms below with random fillers."""
    rng = random.Random(seed)
    syllables = "the an re on ti er ou le de pa en ión ra do sch ge un ver mar lin ka".split()

    def plain() -> str:
        word = "".join(rng.choices(syllables, k=rng.randint(1, 4)))
        return (word.capitalize() if rng.random() < 0.2 else word) + rng.choice(["", "", "", "", ".", ","])

    def mark(of: str, size: int) -> str:
        return "".join(rng.choices(of, k=size))

    hexes, capitals, small = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"
    name = lambda: mark(small, rng.randint(4, 8))
    number = lambda n: mark("0123456789", n)
    # {kind|words}: a span; everything else is outside
    forms: list[Callable[[], str]] = [
        lambda: f'token = " {{secret|{mark(hexes, rng.choice([32, 40, 64]))}}} "',
        lambda: f'secret = " {{secret|{mark(hexes, 40)}}} "',
        lambda: f"password = {{secret|{mark(hexes, rng.choice([12, 16, 18, 20]))}}}",
        lambda: f"passwd = {{secret|{mark(small + capitals + '0123456789', 14)}}}",
        lambda: f"api_key : {{secret|{mark(small + capitals, 24)}{number(4)}}}",
        lambda: f"{{secret|AKIA{mark(capitals, 16)}}}",
        lambda: f"key {{secret|AKIA{mark(capitals, 16)}}}",
        lambda: f"Bearer {{secret|{mark(small + capitals + '0123456789', 36)}}}",
        lambda: f"{{email|{name()} at {name()} dot com}}",
        lambda: f"mail {{email|{name()} [at] {name()} [dot] org}}",
        lambda: f"contact {{email|{name()} (at) {name()} dot net}}",
        lambda: f"email {{email|{name()}.{name()} at {name()} dot com}}",
        lambda: f"call {{phone|({number(3)}) {number(3)}-{number(4)}}}",
        lambda: f"phone : {{phone|{number(3)}-{number(3)}-{number(4)}}}",
        lambda: f"tel {{phone|{number(3)}.{number(3)}.{number(4)}}}",
        lambda: f"{{phone|({number(3)}) {number(3)}-{number(4)}}}",
        lambda: f"SSN {{identity|{number(3)}-{number(2)}-{number(4)}}}",
        lambda: f"{{identity|{number(3)}-{number(2)}-{number(4)}}}",
        lambda: f"IBAN {{identity|DE{number(20)}}}",
    ]
    others: list[Callable[[], str]] = [
        lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}",
        lambda: f"on {rng.randint(1, 28)}.{rng.randint(1, 12)}.20{number(2)}", lambda: f"20{number(2)}-0{number(1)}-1{number(1)}",
        lambda: f"in {rng.randint(1800, 2030)}", lambda: f"{number(1)},{number(3)} of {number(2)}", lambda: f"${number(3)}.{number(2)}",
        lambda: f"page {number(3)}", lambda: f"{number(1)}:{number(2)}", lambda: f"{number(2)}%", lambda: f"{name()}{number(2)}",
        lambda: f"BY-NC {rng.randint(1, 4)}.0.", lambda: f"x = {number(2)}", lambda: f"key = {name()}", lambda: f"{name()} = {name()}",
        lambda: f"{number(rng.randint(5, 9))}", lambda: f"the dot at {name()}", lambda: f"{name()} at {name()}",
        lambda: f"{name()} dot {name()}", lambda: f"token {name()}", lambda: f"the password of {name()}",
        lambda: f"{mark(capitals[:26], 20)}", lambda: f"{mark(capitals[:26], 6)}!!", lambda: f"###{number(4)}###", lambda: f"{number(2)}/{number(2)}",
        lambda: f"{name()}{name()}{name()}{name()}", lambda: f"http : //{name()}.org/{number(4)}", lambda: f"{number(16)}",
        lambda: f"{number(3)}.{number(2)}.{number(3)}.{number(2)}", lambda: f"{name()}.{number(2)}@{name()}.com",
        lambda: f"{plain()} at the {plain()} {number(2)}", lambda: f"{name().upper()}!! {name().upper()}!! {number(16)}!! {name().upper()}!!",
        lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: f"{name()}@{name()}.example.com",
    ]
    rows = []
    for form in [f for f in forms for _ in range(2)] + others:
        for _ in range(copies):
            words: list[tuple[str, str]] = [(w, "O") for _ in range(rng.randint(0, 6)) for w in TOKEN.findall(plain())]
            for part in re.split(r"(\{.*?\})", form()):
                kind, text = part[1:-1].split("|") if part.startswith("{") else ("", part)
                for k, w in enumerate(TOKEN.findall(text)):
                    words.append((w, f"{'I' if k else 'B'}-{kind}" if kind else "O"))
            words += [(w, "O") for _ in range(rng.randint(0, 6)) for w in TOKEN.findall(plain())]
            rows.append(words)
    rng.shuffle(rows)
    return rows


def train(rows: list[list[tuple[str, str]]], rounds: int = 80, decay: float = 0.02) -> tuple[dict, np.ndarray]:
    """Weights of features by side (0 own, 1 word before, 2 word after) and of moves; the last row of
    the moves is the start. Maximum likelihood with a quadratic penalty, by Adam over all rows."""
    known: dict[tuple[int, str], int] = {}
    at_state = {s: i for i, s in enumerate(STATES)}
    longest, n = max(map(len, rows)), len(STATES)
    width = 3 * len(word_class("x"))
    features = np.full((len(rows), longest, width), -1)
    labels, sizes = np.zeros((len(rows), longest), int), np.array([len(r) for r in rows])
    for r, row in enumerate(rows):
        classes = [word_class(w) for w, _ in row]
        for t, (_, state) in enumerate(row):
            labels[r, t] = at_state[state]
            sides = [classes[t], classes[t - 1] if t else (), classes[t + 1] if t + 1 < len(row) else ()]
            ids = [known.setdefault((side, f), len(known)) for side, fs in enumerate(sides) for f in fs]
            features[r, t, :len(ids)] = ids
    inside = np.arange(longest)[None] < sizes[:, None]
    w, moves = np.zeros((len(known) + 1, n)), np.zeros((n + 1, n))
    one = np.eye(n)[labels] * inside[..., None]
    seen_moves = np.zeros_like(moves)
    np.add.at(seen_moves, (labels[:, :-1][inside[:, 1:]], labels[:, 1:][inside[:, 1:]]), 1)
    np.add.at(seen_moves, (np.full(len(rows), n), labels[:, 0]), 1)
    tokens, slots = np.nonzero(features.reshape(-1, width) >= 0)
    ids = features.reshape(-1, width)[tokens, slots]
    order = np.argsort(ids, kind="stable")
    by_feature, starts = tokens[order], np.searchsorted(ids[order], np.arange(len(known)))
    slope, square = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        emit = w[features].sum(2)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + moves[n]
        for t in range(1, longest):
            forward[:, t] = emit[:, t] + _log_sum(forward[:, t - 1][:, :, None] + moves[None, :n], 1)
        last = sizes - 1
        for t in range(longest - 2, -1, -1):
            going = _log_sum(moves[None, :n] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t < last)[:, None], going, 0)
        whole = _log_sum(forward[np.arange(len(rows)), last], 1)
        chance = np.exp(forward + backward - whole[:, None, None]) * inside[..., None]
        grad_w = np.zeros_like(w)
        grad_w[:-1] = np.add.reduceat((one - chance).reshape(-1, n)[by_feature], starts, axis=0)
        grad_moves = seen_moves.copy()
        for t in range(1, longest):
            pair = np.exp(forward[:, t - 1][:, :, None] + moves[None, :n] + (emit[:, t] + backward[:, t])[:, None] - whole[:, None, None])
            grad_moves[:n] -= (pair * inside[:, t][:, None, None]).sum(0)
        grad_moves[n] -= chance[:, 0].sum(0)
        for k, (value, grad) in enumerate(((w, grad_w - decay * w), (moves, grad_moves - decay * moves))):
            slope[k] = 0.9 * slope[k] + 0.1 * grad
            square[k] = 0.99 * square[k] + 0.01 * grad * grad
            value += 0.1 * (slope[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
    return {key: w[i] for key, i in known.items()}, moves


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis, keepdims=True)
    return (top + np.log(np.exp(values - top).sum(axis, keepdims=True))).squeeze(axis)


@functools.cache
def trained() -> tuple[dict, np.ndarray]:
    return train(labelled_rows())


def field_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """Spans that the field labels in each text."""
    places, lines = [], []
    for n, text in enumerate(texts):
        if not SEQUENCE.search(text):
            continue
        start = 0
        for line in text.split("\n"):
            if SEQUENCE.search(line):
                tokens = [m.span() for m in TOKEN.finditer(line)]
                places.append((n, start, tokens))
                lines.append([line[a:b] for a, b in tokens])
            start += len(line) + 1
    out: list[list[Span]] = [[] for _ in texts]
    for (n, start, tokens), words, states in zip(places, lines, field.decode(lines)):
        runs: list[Span] = []
        for k in np.flatnonzero(states).tolist():
            first, kind = STATES[states[k]].split("-")
            a, b = tokens[k]
            b = a + len(words[k].rstrip(".!?")) or b
            if first == "I" and runs and runs[-1][0] == kind and states[k - 1]:
                runs[-1] = (kind, runs[-1][1], start + b)
            else:
                runs.append((kind, start + a, start + b))
        out[n] += [(kind, a, b) for kind, a, b in runs if SPELT[kind].search(texts[n][a:b])]
    return out


def personal_data(text: Column) -> Column:
    """``struct<base, added>`` of a text, both ``array<struct<kind, start, stop>>``.

    ``base``: the patterns' spans, in the order of ``KINDS``, then by start. ``added``: what the field
    finds beside them, without spans that touch a base span. Code points, ``stop`` exclusive. Null and
    empty texts have none; white-space-free and very long texts take time in proportion to their length.
    """
    weights, moves = trained()
    fields: list[Field] = []

    @F.arrow_udf("struct<base: array<struct<kind: string, start: int, stop: int>>, added: array<struct<kind: string, start: int, stop: int>>>")
    def find(column: pa.Array) -> pa.Array:
        if not fields:
            fields.append(Field(weights, moves))
        texts = [t or "" for t in column.to_pylist()]
        base, added = [base_spans(t) for t in texts], []
        for own, more in zip(base, field_spans(fields[0], texts)):
            added.append(_apart(own, more))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        listed = [pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in spans] for spans in rows], kind)
                  for rows in (base, added)]
        return pa.StructArray.from_arrays(listed, names=["base", "added"])
    return find.asNondeterministic()(text)


def _apart(base: list[Span], more: list[Span]) -> list[Span]:
    """Those of ``more`` that touch no span of ``base``: none that starts before their end reaches beyond their start."""
    ordered = sorted((start, stop) for _, start, stop in base)
    starts = [start for start, _ in ordered]
    reach = list(accumulate((stop for _, stop in ordered), max, initial=0))
    return [s for s in more if reach[bisect_left(starts, s[2])] <= s[1]]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``personal`` appended: ``personal_data`` of ``text``."""
    return docs.withColumn(free_name(docs.columns, "personal"), personal_data(F.col("text")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


@QUERIES.add("op9_personal_data")
def op9(spark, sf):
    found = find_personal_data(table(spark, sf, "documents").select("doc_id", "text"))
    base, rank = F.col("personal.base"), {k: i for i, k in enumerate((*KINDS, "secret", "identity"))}

    def order(span: Column) -> Column:
        place = F.coalesce(*[F.when(span["kind"] == k, F.lit(i)) for k, i in rank.items()])
        return F.struct(place.alias("place"), span["start"].alias("start"), span["stop"].alias("stop"), span["kind"].alias("kind"))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.transform(F.concat(base, F.col("personal.added")), order))
    return found.select(
        "doc_id", *map(count, KINDS),
        digest(_joined(base)).alias("base_sha256"), _joined(every).alias("spans"))
