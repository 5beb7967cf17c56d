"""Personal data: e-mail addresses, IP addresses, card and phone numbers.

Base spans come from fixed patterns and checks. A semi-Markov conditional
random field adds what the patterns miss, such as numbers without a plus sign
or addresses written with "at" and "dot". It scores whole candidate segments of
at most ``MOST_TOKENS`` tokens by features of the entire span (digits, group
lengths, separators, checksum, neighbouring words), and dynamic programming
over the tokens of a stretch chooses boundaries and types together. Tokens
outside every candidate belong to no entity whatever the weights, so stretches
are decoded apart without changing the best labelling.

The field is trained by conditional likelihood on stretches from at most
``SAMPLE`` documents: base spans as they stand, the same rewritten in ways that the
patterns miss, and the same broken so that they are nothing. Added spans never
overlap base spans.

Null texts count as empty. Rows that repeat are searched each. Offsets are code
points, ends exclusive. Without a base span in the sample no span is added. An
empty table gives an empty table. Columns named like a result are replaced;
others pass through.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.llm.tokens import slices
from hydrolake.sources.shared import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Documents that the field learns from, stretches of them, tokens of a segment, rounds and rate of training.
SAMPLE, STRETCHES, MOST_TOKENS, ROUNDS, RATE, PENALTY = 2000, 1200, 16, 12, 0.3, 1e-3

# Fixed patterns of the base spans, written so that each is found in linear time.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP_RE = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD_RE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end: sorts by start, then kind


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns that pass their checks, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        domain = AT_DOMAIN.match(text, at)
        if domain:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                out.append((start, EMAIL, end))
        at = text.find("@", at + 1)
    for m in IP_RE.finditer(text):
        if all(map(is_octet, m.groups())):
            out.append((m.start(), IP, m.end()))
    for m in CARD_RE.finditer(text):
        if 12 <= m.end() - m.start():
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in PHONE_RE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


# Stretches in which candidates lie.
SEPARATOR = r"(?:[\x20()\[\].+/-]{1,3}|\x20?[(\[]?dot[)\]]?\x20?)"
NUMBERS = re.compile(rf"[+(]{{0,2}}[0-9]+(?:{SEPARATOR}[0-9]+)*")
#: In every address that SPELT accepts; a plain "at" only where a label and a dot follow.
TRIGGER = re.compile(r"@|[(\[]at[)\]]|\bdot\b|\x20at\x20[A-Za-z0-9-]{1,63}(?:\.|\x20?[(\[]dot[)\]])")
SPELT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,6}"
)
LABEL_END = re.compile(r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}")
REACH = 160
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
DIGITS = re.compile("[0-9]+")
WORD = re.compile(r"[A-Za-z]{2,16}")
#: Words before a span that tell its kind (fixed values).
CUES = ("tel", "telephone", "phone", "mobile", "call", "fax", "mail", "email", "contact", "card", "visa", "credit", "ip", "host", "server", "address")


@dataclass
class Stretch:
    """Tokens of a piece of text and its candidate segments: first token, token after the last, kind, features."""

    spans: list[tuple[int, int]]
    segments: list[tuple[int, int, int, list[str]]]


def features(text: str, start: int, end: int, kind: int) -> list[str]:
    """What the whole span says about being an entity of this kind."""
    span = text[start:end]
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    between = DIGITS.split(span)[1:-1]
    before = text[max(0, start - 24) : start]
    words = [w.lower() for w in WORD.findall(before)]
    touching = (before[-1:].isalnum() or before[-1:] in ("=", "_", '"', "+")) + 2 * (text[end : end + 1].isalnum() or text[end : end + 1] in ("_", '"'))
    if before[-1:] in ".-" and before[-2:-1].isdigit() or text[end : end + 1] in ("-", "/") and text[end + 1 : end + 2].isdigit() or text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit():
        touching += 4
    out = ["bias", f"touch={touching}"]
    if any(w in CUES for w in words[-2:]):
        out.append("cue=" + next(w for w in reversed(words) if w in CUES))
    if kind == EMAIL:
        sign = "@" if "@" in span else "(at)" if re.search(r"[(\[]at[)\]]", span) else "at"
        dots = "spelt" if re.search(r"[(\[ ]dot[)\] ]", span) else "dots"
        last = re.split(r"[.\s)\]]", span)[-1]
        out += [f"sign={sign}", f"sign={sign},{dots}", f"last={min(len(last), 5)},{last.isalpha()}", f"spaces={min(span.count(' '), 6)}"]
        return out
    seps = "".join(sorted(set("".join(between).replace("dot", "d"))))
    shape = "-".join(str(min(len(g), 7)) for g in groups[:7])
    out += [f"n={len(digits)}", f"groups={min(len(groups), 8)}", f"seps={seps}", f"shape={shape}", f"plus={span[0] == '+'}", f"open={span.count('(') - span.count(')')}", f"sep1={len(set(between)) <= 1}"]
    if kind == CARD:
        out.append(f"luhn={luhn(digits)}")
        out.append(f"luhn={luhn(digits)},fours={set(map(len, groups[:-1])) <= {4}}")
    if kind == IP:
        out.append(f"octets={all(map(is_octet, groups))}")
        out.append(f"zero={any(len(g) > 1 and g[0] == '0' for g in groups)}")
    return out


def number_stretch(text: str, low: int, high: int) -> Stretch:
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(text, low, high)]
    n_digits = [0]
    for a, b in spans:
        n_digits.append(n_digits[-1] + (b - a if text[a].isdigit() else 0))
    out = Stretch(spans, [])
    for i, (a, _) in enumerate(spans):
        if not (text[a] in "+(" or text[a].isdigit()):
            continue
        groups = 0
        for j in range(i + 1, min(i + MOST_TOKENS, len(spans)) + 1):
            last = spans[j - 1]
            if not text[last[0]].isdigit():
                continue
            groups += 1
            n = n_digits[j] - n_digits[i]
            if n > 19:
                break
            kinds = [k for k, ok in ((IP, groups == 4 and 4 <= n <= 12 and text[a].isdigit()), (CARD, 12 <= n and text[a].isdigit()), (PHONE, 7 <= n <= 15)) if ok]
            out.segments += [(i, j, k, features(text, a, last[1], k)) for k in kinds]
    return out


def spelt_stretch(text: str, low: int, high: int, local_end: int) -> Stretch:
    """An address written out, with a candidate for each end after a label of its domain."""
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(text, low, high)]
    place = {b: i + 1 for i, (_, b) in enumerate(spans)}
    out = Stretch(spans, [])
    for m in LABEL_END.finditer(text, local_end, high):
        if m.end() in place:
            out.segments.append((0, place[m.end()], EMAIL, features(text, low, m.end(), EMAIL)))
    return out


def stretches(text: str) -> Iterator[Stretch]:
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() >= 7:
            s = number_stretch(text, m.start(), m.end())
            if s.segments:
                yield s
    window = None
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if window and low <= window[1]:
            window = (window[0], high)
            continue
        if window:
            yield from _spelt(text, *window)
        window = (low, high)
    if window:
        yield from _spelt(text, *window)


def _spelt(text: str, low: int, high: int) -> Iterator[Stretch]:
    for m in SPELT.finditer(text, low, high):
        yield spelt_stretch(text, m.start(), m.end(), m.start() + 1)


@dataclass
class Field:
    """Weights of (feature, kind) pairs and of a kind that directly follows another."""

    weights: dict[tuple[str, int], float]
    follow: np.ndarray

    def scores(self, s: Stretch) -> list[float]:
        get = self.weights.get
        return [sum(get((f, k), 0.0) for f in names) for _, _, k, names in s.segments]

    def decode(self, s: Stretch) -> list[Span]:
        """The best labelling: its entities. State: the kind that ends at a place, or none (last index)."""
        score = self.scores(s)
        if not any(x > 0 for x in score):
            return []
        n, none = len(s.spans), len(KINDS)
        best = [[-np.inf] * (none + 1) for _ in range(n + 1)]
        back: list[list] = [[None] * (none + 1) for _ in range(n + 1)]
        best[0][none] = 0.0
        ends: dict[int, list[int]] = {}
        for x, (_, j, _, _) in enumerate(s.segments):
            ends.setdefault(j, []).append(x)
        for j in range(1, n + 1):
            state = max(range(none + 1), key=lambda y: best[j - 1][y])
            best[j][none], back[j][none] = best[j - 1][state], (j - 1, state)
            for x in ends.get(j, ()):
                i, _, k, _ = s.segments[x]
                for y in range(none + 1):
                    value = best[i][y] + score[x] + (self.follow[y, k] if y < none else 0.0)
                    if value > best[j][k]:
                        best[j][k], back[j][k] = value, (i, y)
        out, j, state = [], n, max(range(none + 1), key=lambda y: best[n][y])
        while j:
            i, before = back[j][state]
            if state < none:
                out.append((s.spans[i][0], state, s.spans[j - 1][1]))
            j, state = i, before
        return out[::-1]


def expected(s: Stretch, score: list[float], follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each segment and expected number of each follow-up, by the forward and backward sums."""
    n, none = len(s.spans), len(KINDS)
    ahead = np.zeros((n + 1, none + 1))
    ahead[0, none] = 1.0
    behind = np.zeros((n + 1, none + 1))
    behind[n] = 1.0
    turn = np.exp(np.vstack([follow, np.zeros(none)]))  # from a state into a kind
    weight = np.exp(np.clip(score, -30, 30))
    order = range(len(s.segments))
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for x in order:
        by_end.setdefault(s.segments[x][1], []).append(x)
        by_start.setdefault(s.segments[x][0], []).append(x)
    for j in range(1, n + 1):
        ahead[j, none] = ahead[j - 1].sum()
        for x in by_end.get(j, ()):
            i, _, k, _ = s.segments[x]
            ahead[j, k] += (ahead[i] * turn[:, k]).sum() * weight[x]
    for i in range(n - 1, -1, -1):
        behind[i] += behind[i + 1, none]
        for x in by_start.get(i, ()):
            _, j, k, _ = s.segments[x]
            behind[i] += turn[:, k] * weight[x] * behind[j, k]
    z = ahead[n].sum()
    chance, turns = np.zeros(len(s.segments)), np.zeros_like(follow)
    for x in order:
        i, j, k, _ = s.segments[x]
        paths = ahead[i] * turn[:, k] * weight[x] * behind[j, k] / z
        chance[x] = paths.sum()
        turns[:, k] += paths[:none]
    return chance, turns


def learn(examples: list[tuple[Stretch, set[Span]]], rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Maximise the conditional likelihood of the entities of each stretch, by adaptive gradient steps."""
    field = Field({}, np.zeros((len(KINDS), len(KINDS))))
    seen: dict = {}
    turns_seen = np.full(field.follow.shape, 1e-6)
    mix = random.Random(7)
    for _ in range(rounds):
        mix.shuffle(examples)
        for s, gold in examples:
            chance, turns = expected(s, field.scores(s), field.follow)
            change: dict[tuple[str, int], float] = {}
            marked = {}
            for x, (i, j, k, names) in enumerate(s.segments):
                truth = (s.spans[i][0], k, s.spans[j - 1][1]) in gold
                if truth:
                    marked[j] = (i, k)
                error = truth - chance[x]
                if abs(error) > 1e-4:
                    for f in names:
                        change[f, k] = change.get((f, k), 0.0) + error
            actual = np.zeros_like(turns)
            for i, k in marked.values():
                if i in marked:
                    actual[marked[i][1], k] += 1
            for key, g in change.items():
                g -= penalty * field.weights.get(key, 0.0)
                seen[key] = seen.get(key, 1e-6) + g * g
                field.weights[key] = field.weights.get(key, 0.0) + rate * g / seen[key] ** 0.5
            g = actual - turns - penalty * field.follow
            turns_seen += g * g
            field.follow += rate * g / np.sqrt(turns_seen)
    return field


def rewritten(span: str, kind: int, rng: random.Random) -> list[tuple[str, bool]]:
    """Forms of a base span: (text, is still that kind)."""
    digits = NOT_DIGIT.sub("", span)

    def other(d: str) -> str:
        return str((int(d) + rng.randint(1, 9)) % 10)

    if kind == EMAIL:
        name, domain = span.split("@", 1)
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), (" @ ", "."), (" at ", ".")])
        return [(name + at + domain.replace(".", dot), True), (f"{name} at {domain.split('.')[0]}", False)]
    if kind == IP:
        parts = span.split(".")
        sep = rng.choice(["[.]", " dot ", "(.)", " . "])
        at = rng.randrange(4)
        worse = parts[:at] + [str(256 + rng.randrange(700))] + parts[at + 1 :]
        return [(sep.join(parts), True), (sep.join(worse), False), (".".join(worse), False), (".".join(parts[:3]), False), (" ".join(parts), False)]
    if kind == CARD:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        bad = digits[:-1] + other(digits[-1])
        worse = [bad[i : i + 4] for i in range(0, len(bad), 4)]
        sep = rng.choice([".", " - ", "  ", "/"])
        return [(sep.join(fours), True), (sep.join(worse), False), (bad, False), ("-".join(worse), False), (digits[: rng.randint(7, 11)], False)]
    area, rest = digits[-10:-7], digits[-7:]
    forms = [f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"1 ({area}) {rest[:3]}-{rest[3:]}", f"1-{area}-{rest[:3]}-{rest[3:]}", f"{area} {rest[:3]} {rest[3:]}"]
    year = f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    return [(rng.choice(forms), True), (digits, False), (digits[:8], False), (year, False), (f"{digits[:2]} {digits[2:4]} {digits[4:7]}", False), (f"{digits[:4]} {digits[4:8]}", False)]


def examples_of(texts: Iterable[str], most: int = STRETCHES) -> list[tuple[Stretch, set[Span]]]:
    """Labelled stretches: base spans in their places, rewritten, and broken."""
    rng, out = random.Random(11), []
    for text in texts:
        spans = base_spans(text)
        for s in stretches(text):
            if s.spans[-1][1] - s.spans[0][0] < 400:
                low, high = s.spans[0][0], s.spans[-1][1]
                inner = [x for x in spans if low <= x[0] and x[2] <= high]
                # Of overlapping base spans the longest stands.
                gold: set[Span] = set()
                for x in sorted(inner, key=lambda x: (x[0] - x[2], x)):
                    if all(x[2] <= g[0] or g[2] <= x[0] for g in gold):
                        gold.add(x)
                out.append((s, gold))
        for start, kind, end in spans:
            left, right = text[max(0, start - 30) : start], text[end : end + 30]
            for new, good in rewritten(text[start:end], kind, rng):
                made = left + new + right
                low, high = len(left), len(left) + len(new)
                for s in stretches(made):
                    if s.spans[0][0] < high and low < s.spans[-1][1]:
                        out.append((s, {(low, kind, high)} if good else set()))
        if len(out) >= 4 * most:
            break
    rng.shuffle(out)
    return out[:most]


#: What a neighbourhood holds, by pattern; the first that fits counts.
SORTS = (r"@", r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]", r"\+[0-9]", r"[0-9]{3}")
NEAR = r"((?s).{0,60}(?:[0-9]{3}|@|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]).{0,80})"


def neighbourhoods(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` different neighbourhoods of digits, dotted numbers or ``@`` from about ``20 * sample``
    different texts, those of smallest hash: four a text at most, the sorts in turn as far as each goes."""
    text_hash = F.xxhash64("text")
    n = docs.agg(F.approx_count_distinct(text_hash, 0.02)).head()[0]
    chosen = docs.select("text").where(F.pmod(text_hash, F.lit(1 << 40)) < int(min(1.0, 20 * sample / max(1, n)) * (1 << 40)))
    all_near = F.array_distinct(F.regexp_extract_all("text", F.lit(NEAR), F.lit(1)))
    by_hash = F.array_sort(F.transform(all_near, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("text"))))
    sort = F.coalesce(*[F.when(F.col("near.text").rlike(p), k) for k, p in enumerate(SORTS)], F.lit(len(SORTS)))
    near = chosen.select(F.explode(F.slice(by_hash, 1, 4)).alias("near")).select("near.h", "near.text", sort.alias("sort")).distinct()
    near = materialize(near, "neighbourhoods")
    found = [[r["text"] for r in near.where(F.col("sort") == k).orderBy("h", "text").limit(sample).collect()] for k in range(len(SORTS) + 1)]
    return [x for turn in itertools.zip_longest(*found) for x in turn if x is not None][:sample]


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field learnt from the ``neighbourhoods`` of a sample of the texts."""
    return learn(examples_of(neighbourhoods(docs, sample)))


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those together with the spans that the field adds."""
    base = base_spans(text)
    edges = sorted((s, e) for s, _, e in base)
    added = []
    for s in stretches(text):
        for start, kind, end in field.decode(s):
            if all(end <= a or b <= start for a, b in edges):
                added.append((start, kind, end))
    return base, sorted({*base, *added})


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(df: DataFrame, field: Field) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (kind, start, end) of ``text``, by start, then kind as in ``KINDS``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = df.sparkSession.sparkContext.broadcast(field)
    df = df.drop("base", "spans")
    target = T.StructType([*df.schema.fields, T.StructField("base", SPANS), T.StructField("spans", SPANS)])
    schema = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [all_spans(t or "", shared.value) for t in batch.column("text").to_pylist()]
            arrays = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in f[i]] for f in found], schema.field(len(schema) - 2 + i).type) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=schema)

    return df.mapInArrow(run, target)
