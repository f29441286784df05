"""Personal data in texts: patterns, and a linear-chain conditional random field over word shapes.

Patterns give the base spans (``base_spans``), each kind leftmost and without overlap, in time linear in the text. The field
adds what they can't state: numbers without their plus sign, addresses with written-out or non-ASCII signs, digits in other groups.

* It is trained on a small table of labelled windows of words (``labelled_windows``): windows around the base spans of a bounded
  sample of the rows, the same windows with the value written in other ways, and windows with other numbers.
* A word's features are its shape (digits, letters and signs, repeats collapsed), how many digits it has, whether they pass the
  card checksum or are four parts up to 255, and the shapes of its neighbours. A word without digits and signs is plain.
* Texts are decoded by Viterbi, many sequences at once as numpy arrays. Plain words have constant scores, so a long run of them
  always passes through state O: ``settled`` derives from the weights after how many words, and sequences are cut there. The
  result is that of the whole text (tests compare them).
* An added span must be plausible for its kind and lie apart from all base spans, which stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.registry import query
from meetlake.llm.shared import bounded, table

KINDS = ("email", "ip", "card", "phone")
#: Rows that the labelled windows are taken from, and windows that the field is trained on, at most (about).
SAMPLE, WINDOWS = 4_000, 20_000
#: Words on either side of a value in a window.
AROUND = 5
STEPS, RATE, RIDGE = 250, 0.1, 0.02

# --- base patterns -----------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def digits_of(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def luhn(digits: str) -> bool:
    """Whether 13 to 19 digits pass the card checksum."""
    if not 13 <= len(digits) <= 19:
        return False
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def octets(parts: Sequence[str]) -> bool:
    """Whether all parts are numbers up to 255."""
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; places are code points, the end is exclusive."""
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m.group().split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and luhn(digits_of(m.group()))]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- words and their types ---------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@+()\[\]]")
_SPACES = " \t\n\x0b\x0c\r"
_EDGE = ".,;:!?\"'%#*$&|<>=`~^{}\\/_-"
PLAIN = 0


@lru_cache(1 << 16)
def core(word: str) -> tuple[int, int]:
    """Where the word stands without the punctuation around it."""
    end = len(word.rstrip(_EDGE))
    return min(len(word) - len(word.lstrip(_EDGE)), end), end


def shape(word: str) -> str:
    """Digits as 9, letters as a, other signs as they are; runs of the first two collapsed; 24 signs at most."""
    out = []
    for c in word:
        c = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not (out and out[-1] == c and c in "9a"):
            if len(out) == 24:
                break
            out.append(c)
    return "".join(out)


@lru_cache(1 << 16)
def features(word: str) -> tuple[str, ...]:
    """Features of one word; the first is its coarse form, which its neighbours see as well."""
    if not _SIGN.search(word):
        return ("plain",)
    word = word[slice(*core(word))]
    digits, form = digits_of(word), shape(word)
    parts = re.split(r"[^0-9]+", word.strip("()[]."))
    size = next(k for k, most in enumerate((0, 1, 2, 3, 4, 6, 8, 12, 15, 19, 10**12)) if len(digits) <= most)
    address = len(parts) == 4 and all(parts) and octets(parts)
    ascii_form = "".join("a" if c == "a" else c for c in form)
    return (f"shape {form}", f"digits {size}", f"luhn {luhn(digits)}", f"octets {address}", f"form {ascii_form[:6]} {size}",
            f"at {'@' in word}", f"ends {form[:2]} {form[-2:]}", f"sure {form} {size} {luhn(digits)} {address}")


def sequences(text: str, reach: int | None) -> Iterator[tuple[list[tuple[int, int] | None], bool, bool]]:
    """The words of a text that can matter, as runs: places of words with a sign, None for plain ones.

    Plain words are left out (and the run is cut) where more than ``4 * reach + 2`` come together, but for ``reach + 1`` at the
    ends of a run. With each run: whether it begins and whether it ends where the text was cut. Without a reach nothing is cut.
    """
    limit = 4 * reach + 3 if reach is not None else None

    def plain(low: int, high: int) -> int:
        words = _WORD.finditer(text, low, high)
        return sum(1 for _ in (words if limit is None else islice(words, limit)))

    run: list[tuple[int, int] | None] = []
    cut, done = False, 0
    for sign in _SIGN.finditer(text):
        if sign.start() < done:
            continue
        low = max([done, *(text.rfind(c, done, sign.start()) + 1 for c in _SPACES)])
        gap = plain(done, low)
        if limit is not None and gap == limit:
            if run:
                yield [*run, *[None] * (reach + 1)], cut, True
            run, cut = [None] * (reach + 1), True
        else:
            run += [None] * gap
        done = _WORD.match(text, low).end()
        run.append((low, done))
    if run:
        gap = plain(done, len(text))
        if limit is not None and gap == limit:
            yield [*run, *[None] * (reach + 1)], cut, True
        else:
            yield [*run, *[None] * gap], cut, False


# --- the field ---------------------------------------------------------------------------------------------------

#: State 0 is O; of kind k, 2k + 1 begins a value and 2k + 2 goes on with it.
STATES = 1 + 2 * len(KINDS)
_NEVER = -1e4
_ALLOWED = np.zeros((STATES, STATES))
for _k in range(len(KINDS)):
    _inside = 2 * _k + 2
    _ALLOWED[:, _inside] = _NEVER
    _ALLOWED[[_inside - 1, _inside], _inside] = 0.0
_START = np.array([0.0 if s == 0 or s % 2 else _NEVER for s in range(STATES)])
_PLACES = ("own", "before", "after")


class Field:
    """Weights of the features of a word and its neighbours by state, and of steps between states."""

    def __init__(self, names: Sequence[str] = (), weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.number = {n: k for k, n in enumerate(names)}
        self.weights = np.zeros((len(self.number), STATES)) if weights is None else weights
        self.steps = _ALLOWED if steps is None else steps + _ALLOWED
        self.types: dict[tuple[str, ...], int] = {}
        self.scores = np.zeros((0, 3, STATES))
        self.type_of(("plain",))

    def __reduce__(self):
        return Field, (tuple(self.number), self.weights, self.steps - _ALLOWED)

    def type_of(self, found: tuple[str, ...]) -> int:
        """Number of a set of features; its scores are added up once. Features not seen in training count nothing."""
        number = self.types.get(found)
        if number is None:
            rows = np.zeros((1, 3, STATES))
            for p, place in enumerate(_PLACES):
                for f in found if place == "own" else found[:1]:
                    if (k := self.number.get(f"{place} {f}")) is not None:
                        rows[0, p] += self.weights[k]
            number = self.types[found] = len(self.types)
            self.scores = np.concatenate((self.scores, rows))
        return number

    def emissions(self, types: np.ndarray) -> np.ndarray:
        """Scores (sequence, place, state) of types by sequence, -1 past the end; neighbours beyond the ends are plain."""
        padded = np.pad(np.where(types < 0, PLAIN, types), ((0, 0), (1, 1)), constant_values=PLAIN)
        return self.scores[padded[:, 1:-1], 0] + self.scores[padded[:, :-2], 1] + self.scores[padded[:, 2:], 2]

    def viterbi(self, types: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best states of sequences of types (-1 past the end); ``begins`` and ``ends``: those states are O."""
        count, width = types.shape
        score = self.emissions(types)
        size = (types >= 0).sum(1)
        best = score[:, 0] + _START
        best[begins, 1:] = _NEVER
        back = np.zeros((width, count, STATES), np.int8)
        for t in range(1, width):
            step = best[:, :, None] + self.steps
            back[t] = step.argmax(1)
            going = t < size
            best[going] = step.max(1)[going] + score[going, t]
        best[ends, 1:] += 10 * _NEVER
        states = np.zeros((count, width), np.int8)
        now = best.argmax(1)
        rows = np.arange(count)
        for t in range(width - 1, -1, -1):
            here = t < size
            states[here, t] = now[here]
            now = np.where(here & (t > 0), back[t][rows, now], now)
        return states

    def settled(self, most: int = 8) -> int | None:
        """After how many plain words the best path is at O, whatever lies around; None if not within ``most``."""
        step = self.steps + self.emissions(np.full((1, 3), PLAIN))[0, 1]

        def then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, :, None] + b[None]).max(1)

        powers = [step]
        while len(powers) < max(2 * most, STATES):
            powers.append(then(powers[-1], step))
        # no loop of states is better than staying at O
        if any((np.diag(p) > (t + 1) * step[0, 0] + 1e-9).any() for t, p in enumerate(powers[:STATES])):
            return None
        for k in range(1, most + 1):
            half, whole = powers[k - 1], powers[2 * k - 1]
            through = half[:, :1] + half[:1]
            start = (_START[:, None] + self.emissions(np.full((1, 3), PLAIN))[0, 1][:, None] + half)[:, 0]
            if (whole <= through + 1e-9).all() and start.argmax() == 0 and half[0].argmax() == 0:
                return k
        return None

    @classmethod
    def trained(cls, rows: Sequence[tuple[list[str], list[int]]]) -> Field:
        """The field with the largest penalised likelihood of labelled windows (words, states), by steps of Adam.

        Windows with the same features and states are one row with a weight. Without windows all weights are 0.
        """
        counted = Counter((tuple(features(w) for w in words), tuple(states)) for words, states in rows if words)
        names = sorted({f"{place} {f}" for found, _ in counted for word in found
                        for place in _PLACES for f in (word if place == "own" else word[:1])} | {
                            f"{place} plain" for place in _PLACES})
        field = cls(names)
        if not counted:
            return field
        ordered = sorted(counted)
        width = max(len(s) for _, s in ordered)
        types = np.full((len(ordered), width), -1)
        states = np.zeros((len(ordered), width), np.int64)
        for r, (found, s) in enumerate(ordered):
            types[r, :len(s)] = [field.type_of(f) for f in found]
            states[r, :len(s)] = s
        # rare windows count too: a weight is the root of the number of windows
        weight = np.sqrt(np.array([counted[c] for c in ordered], float))
        known = [None] * len(field.types)
        for found, number in field.types.items():
            known[number] = [[field.number[f"{place} {f}"] for f in (found if place == "own" else found[:1])] for place in _PLACES]
        of_type = np.zeros((len(known), 3, len(names)), np.float32)
        for number, places in enumerate(known):
            for p, ks in enumerate(places):
                of_type[number, p, ks] = 1
        flat = of_type.reshape(-1, len(names))
        live = types >= 0
        padded = np.pad(np.where(live, types, PLAIN), ((0, 0), (1, 1)), constant_values=PLAIN)
        # places in order of their type, for sums by type
        around = [p[live] for p in (padded[:, 1:-1], padded[:, :-2], padded[:, 2:])]
        around = [(order := np.argsort(p, kind="stable"), *np.unique(p[order], return_index=True)) for p in around]
        moments = [np.zeros((len(names) + STATES, STATES)) for _ in range(2)]
        values = np.zeros((len(names) + STATES, STATES))
        for turn in range(1, STEPS + 1):
            field.weights, field.steps = values[:len(names)], values[len(names):] + _ALLOWED
            field.scores = (flat @ field.weights).reshape(len(known), 3, STATES)
            node, edge = field._expected(types, states, weight)
            by_type = np.zeros((len(known), 3, STATES))
            for p, (order, present, first) in enumerate(around):
                by_type[present, p] = np.add.reduceat(node[live][order], first)
            slope = np.concatenate((flat.T @ by_type.reshape(-1, STATES), edge)) / weight.sum() + RIDGE * values / weight.sum()
            for m, power, keep in zip(moments, (1, 2), (0.9, 0.999)):
                m *= keep
                m += (1 - keep) * slope**power
            values = values - RATE * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.999**turn)) + 1e-8)
        return cls(names, values[:len(names)].copy(), values[len(names):].copy())

    def _expected(self, types: np.ndarray, states: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected less observed counts: of states by place, and of steps; from messages forward and backward.

        Messages are scaled to sum 1 at every place, so no sum leaves the range of doubles.
        """
        count, width = types.shape
        score, live, rows = self.emissions(types), types >= 0, np.arange(count)
        score = np.exp(score - score.max(2, keepdims=True))
        step = np.exp(self.steps)
        ahead, size = np.zeros((width, count, STATES)), np.ones((width, count))
        now = score[:, 0] * np.exp(_START)
        for t in range(width):
            if t:
                now = np.where(live[:, t, None], (ahead[t - 1] @ step) * score[:, t], ahead[t - 1])
            size[t] = now.sum(1)
            ahead[t] = now / size[t][:, None]
        behind = np.ones((count, STATES))
        node, edge = np.zeros((count, width, STATES)), np.zeros((STATES, STATES))
        for t in range(width - 1, -1, -1):
            here = live[:, t]
            node[here, t] = (ahead[t] * behind)[here] * weight[here, None]
            node[rows[here], t, states[here, t]] -= weight[here]
            if t:
                message = score[:, t] * behind / size[t][:, None]
                edge += (ahead[t - 1].T @ (message * (weight * here)[:, None])) * step
                np.add.at(edge, (states[here, t - 1], states[here, t]), -weight[here])
                behind = np.where(here[:, None], message @ step.T, behind)
        return node, edge


# --- the labelled table ------------------------------------------------------------------------------------------


def other_forms(kind: str, value: str) -> list[str]:
    """The value as people write it where the patterns don't see it."""
    digits = digits_of(value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return [f"{local}(at){domain}", f"{local}[at]{domain}", f"{local}[at]{domain.replace('.', '[dot]')}",
                f"{local}(at){domain.replace('.', '(dot)')}", f"{local}é@{domain}", f"{local}@{domain.replace('.', '[.]')}"]
    if kind == "ip":
        return [value.replace(".", "[.]"), value.replace(".", "(.)"), value.replace(".", "[dot]")]
    if kind == "card":
        groups = [digits[k:k + 4] for k in range(0, len(digits), 4)]
        return [".".join(groups), "_".join(groups), "/".join(groups)]
    area, rest = digits[-10:-7], f"{digits[-7:-4]}-{digits[-4:]}"
    return [f"({area}) {rest}", f"{area}-{rest}", f"({area}){rest}", f"{area}.{rest.replace('-', '.')}", f"{area}/{rest}"]


def other_numbers(n: int) -> list[str]:
    """Numbers that are no personal data, made from any number."""
    a, b, c = n % 12 + 1, n // 12 % 28 + 1, 1950 + n // 7 % 90
    return [f"{c}-{a:02}-{b:02}", f"{b:02}/{a:02}/{c}", f"{a}:{b:02}:{n % 60:02}", f"{a}.{b}.{n % 9}", f"${a},{b:03}.{n % 90 + 10}",
            f"({c})", f"[{b}]", f"{b}-{b + a}", f"#{n % 997}", f"{n % 10**9:09}", f"@{'abcdefgh'[n % 8] * 3}", f"v{a}.{b}", f"f({b})",
            f"{n * 7919 % 10**12:012}", f"{c}/{c + 1}", f"{a}+{b}", f"{a}.", f"{b})", f"{n % 100}%", f"ab-{n % 10**5:05}"]


def windows(text: str, turn: int) -> Iterator[tuple[list[str], list[int]]]:
    """Labelled windows of one text: its base spans, the same in other forms, and other numbers. Labels are states."""

    def window(left: str, value: str, right: str, kind: str | None) -> tuple[list[str], list[int]]:
        whole = left + value + right
        words, states, inside = [], [], False
        for m in _WORD.finditer(whole):
            a, b = (m.start() + x for x in core(m.group()))
            of_value = kind is not None and a < len(left) + len(value) and b > len(left) and a < b
            words.append(m.group())
            states.append((2 * KINDS.index(kind) + 1 + inside) if of_value else 0)
            inside = of_value
        middle = [k for k, s in enumerate(states) if s] or [len(_WORD.findall(left))]
        low, high = max(0, middle[0] - AROUND), middle[-1] + AROUND + 1
        return words[low:high], states[low:high]

    spans = base_spans(text)
    taken = sorted((a, b) for _, a, b in spans)

    def context(a: int, b: int) -> tuple[str, str]:
        """What stands before and after, up to the next value and 200 signs at most."""
        low = max([a - 200, 0, *(y for _, y in taken if y <= a)])
        high = min([b + 200, len(text), *(x for x, _ in taken if x >= b)])
        return text[low:a], text[b:high]

    for n, (kind, a, b) in enumerate(spans[:50]):
        if any(x < b and a < y and (x, y) != (a, b) for x, y in taken):
            continue
        left, right = context(a, b)
        yield window(left, text[a:b], right, kind)
        for form in other_forms(kind, text[a:b]):
            yield window(left, form, right, kind)
        other = other_numbers(turn + n)
        yield window(left, other[(turn + n) % len(other)], right, None)
    held = [m.span() for m in islice(_WORD.finditer(text), 400) if _SIGN.search(m.group())
            and not any(x < m.end() and m.start() < y for x, y in taken)]
    for a, b in held[:10]:
        left, right = context(a, b)
        yield window(left, text[a:b], right, None)
    plain = _WORD.search(text, len(text) // 2)
    if plain and not any(x < plain.end() and plain.start() < y for x, y in taken):
        left, right = context(*plain.span())
        other = other_numbers(turn)
        for value in (plain.group(), other[turn % len(other)]):
            yield window(left, value, right, None)


def labelled_windows(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(words, states): windows of about ``sample`` rows, chosen by a hash of id and text. Long texts give 50 values each."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, turn in zip(batch.column("text"), batch.column("turn").to_pylist()):
                found = [w for w in windows(text.as_py(), turn) if w[0]]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.list_(pa.string())),
                                                  pa.array([s for _, s in found], pa.list_(pa.int32()))], ["words", "states"])

    chosen = bounded(rows, sample, "id", "text").select("text", F.pmod(F.xxhash64("text"), F.lit(10**6)).alias("turn"))
    return chosen.mapInArrow(run, "words array<string>, states array<int>")


def train(labelled: DataFrame, most: int = WINDOWS) -> Field:
    """The field of a labelled table (words, states); about ``most`` of its rows count, chosen by a hash."""
    rows = bounded(labelled, most, "words", "states").collect()  # bounded
    return Field.trained([(list(r["words"]), list(r["states"])) for r in rows])


# --- spans of texts ----------------------------------------------------------------------------------------------


def plausible(kind: str, value: str) -> bool:
    """Whether an added value could be one of its kind."""
    digits = digits_of(value)
    if kind == "email":
        parts = re.split(r"@|\(at\)|\[at\]", value)
        return len(parts) == 2 and all(any(c.isalnum() for c in p) for p in parts) and "." in parts[1].replace("dot", ".")
    if kind == "ip":
        parts = re.split(r"[^0-9]+", re.sub(r"\[dot\]|\(dot\)", ".", value))
        return len(parts) == 4 and all(parts) and octets(parts)
    if kind == "card":
        return luhn(digits)
    return 9 <= len(digits) <= 15 and re.fullmatch(r"[0-9()./ \t\r\n+-]+", value) is not None


class Reader:
    """Added spans of texts by a field, in batches of sequences of similar length."""

    def __init__(self, field: Field, batch: int = 4096):
        self.field, self.reach, self.batch = field, field.settled(), batch

    def added(self, texts: Sequence[str], bases: Sequence[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        runs = [(n, *run) for n, text in enumerate(texts) for run in sequences(text, self.reach)]
        runs.sort(key=lambda r: len(r[1]))
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for low in range(0, len(runs), self.batch):
            part = runs[low:low + self.batch]
            types = np.full((len(part), len(part[-1][1])), -1)
            for r, (n, words, _, _) in enumerate(part):
                text = texts[n]
                types[r, :len(words)] = [PLAIN if w is None else self.field.type_of(features(text[w[0]:w[1]])) for w in words]
            states = self.field.viterbi(types, np.array([p[2] for p in part]), np.array([p[3] for p in part]))
            for r in np.flatnonzero(states.any(1)):
                n, words, _, _ = part[r]
                out[n] += self._spans(texts[n], words, states[r].tolist())
        return [sorted(s for s in set(spans) if not any(a < s[2] and s[1] < b for _, a, b in base))
                for spans, base in zip(out, bases)]

    @staticmethod
    def _spans(text: str, words: list, states: list[int]) -> Iterator[tuple[str, int, int]]:
        k = 0
        while k < len(words):
            first = k
            k += 1
            if states[first] % 2:
                while k < len(words) and states[k] == states[first] + 1:
                    k += 1
                if words[first] is None or words[k - 1] is None:
                    continue
                (a, b), (c, d) = words[first], words[k - 1]
                start, end = a + core(text[a:b])[0], c + core(text[c:d])[1]
                kind = KINDS[states[first] // 2]
                if plausible(kind, text[start:end]):
                    yield kind, start, end


def found_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): of every row the base spans, and all spans, as arrays of (kind, start, end).

    Places are code points, ends exclusive; spans go by kind, then start. Null counts as the empty text, which has none; ids
    may be null or repeat: every row is read by itself. Other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # as large as its labelled table has forms of words
    rank = {k: n for n, k in enumerate(KINDS)}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def listed(rows: list) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for whole in batches:
            for low in range(0, len(whole), 512):
                batch = whole.slice(low, 512)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                spans = [sorted([*b, *a], key=lambda s: (rank[s[0]], *s[1:])) for b, a in zip(base, reader.added(texts, base))]
                if len(reader.field.types) > 1 << 16:
                    reader = Reader(sent.value.__class__(*sent.value.__reduce__()[1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed(base), listed(spans)], ["doc_id", "base", "spans"])

    form = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, base {form}, spans {form}")


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = found_spans(docs, train(labelled_windows(docs)))

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"),
                        (F.size("spans") - F.size("base")).alias("n_added"))
