"""Secret scan: patterns, and formats inferred from the credentials the patterns label.

The base patterns find assigned values, access keys and hexadecimal keys. What they find labels
credentials; from a bounded sample of them, one probabilistic automaton per kind is inferred: a
prefix tree of character classes whose states are merged where their outgoing frequencies are
statistically compatible (Hoeffding bound). An automaton of ordinary tokens is inferred the same
way. Every further token that could be a credential is scored by the difference of the mean log
likelihoods; tokens beyond the threshold become spans of kind "format". Candidates are all tokens from
the length that an assigned value counts from. The length of a token is a part of its likelihood, and
as the mean of a short token varies more, the score is the mean times the root of its number of terms.
The threshold is set on ordinary tokens that were held out. The base spans always stay.

Defined results: NULL text is read as empty: no spans, the digest of the empty string. Repeated
rows each get their row. Without labelled credentials only the base patterns work. Positions are
code points, end exclusive. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm.common import table, written
from isotherm.llm.words import map_rows

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LETTER = re.compile("[A-Za-z]")
NUMBERS = "#"                   # ordinary tokens without letters: addresses, telephone numbers, dates
LEAST = 6                       # characters of an assigned value, and of a candidate
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")

MAX_LABELLED = 400              # distinct credentials per kind that an automaton is inferred from
MAX_ORDINARY = 2000             # ordinary tokens, half for inference, half for the threshold
SIGNIFICANCE = 0.01             # of the compatibility test
FALSE_ALARMS = 0.001            # share of held-out ordinary tokens beyond the threshold
REMEMBERED = 200_000            # tokens whose verdict a task keeps, so that a common word is scored once


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), per kind leftmost and not overlapping."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def free_tokens(text: str, taken: list[tuple[str, int, int]]):
    """Matches of TOKEN that touch no base span."""
    ranges, i, reach = sorted((a, b) for _, a, b in taken), 0, 0
    for m in TOKEN.finditer(text):
        # reach: furthest end of the spans that begin before the token's end
        while i < len(ranges) and ranges[i][0] < m.end():
            reach = max(reach, ranges[i][1])
            i += 1
        if reach <= m.start():
            yield m


def char_class(c: str) -> str:
    if c.isdigit():
        return "9"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "F":
        return "A"
    return "G" if "G" <= c <= "Z" else c


@dataclass
class Automaton:
    """Probabilistic automaton over character classes, and how often each character stands for its class.

    moves[state]: class -> (next state, count); ends[state]: strings that end there; lengths: of the strings.
    """
    moves: list[dict[str, list]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    chars: dict[str, float] = field(default_factory=dict)
    lengths: Counter = field(default_factory=Counter)
    _logs: tuple | None = field(default=None, repr=False, compare=False)

    def _prepared(self) -> tuple:
        """Per state the logarithms of its moves, of a move it has not and of the end; per character its class and logarithm; of lengths."""
        if self._logs is None:
            states = []
            for moves, ends in zip(self.moves, self.ends):
                seen = ends + sum(m[1] for m in moves.values()) + 1.5
                states.append(({k: (math.log((n + 0.1) / seen), to) for k, (to, n) in moves.items()}, (math.log(0.1 / seen), None),
                               math.log((ends + 0.1) / seen)))
            n = sum(self.lengths.values()) + 1.5
            self._logs = (states, {c: (char_class(c), x) for c, x in self.chars.items()},
                          {k: math.log((x + 0.1) / n) for k, x in self.lengths.items()}, math.log(0.1 / n))
        return self._logs

    def log_likelihood(self, token: str) -> float:
        """Mean natural logarithm per character, the end and the length included."""
        states, chars, lengths, other = self._prepared()
        state, total = 0, lengths.get(len(token), other)
        for c in token:
            k, own = chars.get(c) or (char_class(c), -8.0)
            total += own
            if state is None:
                total += -4.0
                continue
            moves, none, _ = states[state]
            step, state = moves.get(k, none)
            total += step
        if state is not None:
            total += states[state][2]
        return total / (len(token) + 1)


def infer(tokens: list[str], significance: float = SIGNIFICANCE) -> Automaton:
    """Prefix tree of the tokens with compatible states merged, nearest to the root first."""
    moves: list[dict[str, list]] = [{}]
    ends = [0]
    for t in tokens:
        s = 0
        for c in t:
            step = moves[s].setdefault(char_class(c), [len(moves), 0])
            if step[1] == 0:
                moves.append({})
                ends.append(0)
            step[1] += 1
            s = step[0]
        ends[s] += 1
    bound = math.sqrt(0.5 * math.log(2 / significance))

    def seen(s: int) -> int:
        return ends[s] + sum(m[1] for m in moves[s].values())

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = seen(a), seen(b)
            if differ(ends[a], n1, ends[b], n2):
                return False
            for k in moves[a].keys() | moves[b].keys():
                x, y = moves[a].get(k), moves[b].get(k)
                if differ(x[1] if x else 0, n1, y[1] if y else 0, n2):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        """The tree below b goes into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            for k, (to, n) in moves[b].items():
                mine = moves[a].get(k)
                if mine is None:
                    moves[a][k] = [to, n]
                else:
                    mine[1] += n
                    todo.append((mine[0], to))

    red, known = [0], {0}
    while True:
        # the next state below the red ones; a fold may have hung new ones anywhere below them
        blue = next(((r, k) for r in red for k in sorted(moves[r]) if moves[r][k][0] not in known), None)
        if blue is None:
            break
        parent, k = blue
        b = moves[parent][k][0]
        into = next((r for r in red if compatible(r, b)), None)
        if into is None:
            red.append(b)
            known.add(b)
        else:
            moves[parent][k][0] = into
            fold(into, b)
    at = {s: i for i, s in enumerate(red)}
    out = Automaton([{k: [at[to], n] for k, (to, n) in moves[s].items()} for s in red], [ends[s] for s in red])
    count = Counter(c for t in tokens for c in t)
    per = Counter()
    for c, n in count.items():
        per[char_class(c)] += n
    out.lengths = Counter(len(t) for t in tokens)
    out.chars = {c: math.log(n / per[char_class(c)]) for c, n in count.items()}
    return out


@dataclass
class Formats:
    kinds: dict[str, Automaton] = field(default_factory=dict)
    ordinary: Automaton | None = None
    threshold: float = math.inf

    def score(self, token: str) -> float:
        """How much likelier a credential's format is than an ordinary token's: per character, times the root of their number."""
        if not self.kinds or self.ordinary is None:
            return -math.inf
        more = max(a.log_likelihood(token) for a in self.kinds.values()) - self.ordinary.log_likelihood(token)
        return more * math.sqrt(len(token) + 1)

    def spans(self, text: str, taken: list[tuple[str, int, int]], known: dict[str, bool] | None = None) -> list[tuple[str, int, int]]:
        """Further spans; tokens that touch a base span are not looked at again. known: verdicts so far."""
        out, known = [], {} if known is None else known
        if not self.kinds or self.ordinary is None:
            return out
        for m in free_tokens(text, taken):
            t = m.group()
            hit = known.get(t)
            if hit is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                # a bare number is no credential, whatever its length
                hit = known[t] = not t.isdigit() and self.score(t) > self.threshold
            if hit:
                out.append(("format", *m.span()))
        return out


def digest_order(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


class Lowest:
    """The tokens with the lowest hashes, at most limit of them."""

    def __init__(self, limit: int):
        self.limit, self.held, self.heap = limit, set(), []

    def add(self, token: str) -> None:
        h = xxhash.xxh3_64_intdigest(token) >> 1
        if len(self.heap) < self.limit:
            if token not in self.held:
                self.held.add(token)
                heapq.heappush(self.heap, (-h, token))
        elif h < -self.heap[0][0] and token not in self.held:
            self.held.add(token)
            self.held.discard(heapq.heappushpop(self.heap, (-h, token))[1])


def _examples(docs: DataFrame, text: str, per_kind: int, ordinary: int) -> dict[str, list[str]]:
    """Bounded samples, lowest hash first: labelled credentials of each kind, and ordinary tokens.

    Every task keeps its lowest hashes of each kind while it reads all its texts; the lowest of all
    are among them. What is sent on is bounded by the number of tasks.
    """
    limits = {k: per_kind for k in KINDS[:3]} | {"": ordinary, NUMBERS: ordinary}

    def run(batches):
        lowest = {k: Lowest(n) for k, n in limits.items()}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                found = base_spans(t)
                for k, a, b in found:
                    if k != "assign":
                        lowest[k].add(t[a:b])
                    else:
                        lowest[k].add(ASSIGN.match(t, a).group(2))
                for w in {m.group() for m in free_tokens(t, found)}:
                    lowest["" if LETTER.search(w) else NUMBERS].add(w)
        rows = [(k, w, -h) for k, x in lowest.items() for h, w in x.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["kind", "token", "h"])

    seen = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "kind string, token string, h bigint")
    each = written(seen, "tokens").groupBy("kind", "token").agg(F.min("h").alias("h"))
    # a limit per kind: every task of the aggregate sends its lowest only
    parts = [each.where(F.col("kind") == k).orderBy("h", "token").limit(n) for k, n in limits.items()]
    out = {k: [] for k in limits}
    for r in reduce(DataFrame.unionByName, parts).collect():
        out[r.kind].append((r.h, r.token))
    return {k: [t for _, t in sorted(x)] for k, x in out.items()}


def learn(docs: DataFrame, text: str = "text", per_kind: int = MAX_LABELLED, ordinary: int = MAX_ORDINARY) -> Formats:
    seen = _examples(docs, text, per_kind, ordinary)
    words = [t for t in seen[""] if not any(c.isdigit() for c in t)] or seen[""]
    if len(words) < 20 or not any(seen[k] for k in KINDS[:3]):
        return Formats()
    half = len(words) // 2
    kinds = {k: infer(seen[k]) for k in KINDS[:3] if len(seen[k]) >= 5}
    # candidates include numbers with signs, of which the words say nothing
    out = Formats(kinds, infer(words[:half] + seen[NUMBERS][:ordinary // 2]))
    if kinds:
        held = sorted(out.score(t) for t in words[half:])
        out.threshold = max(0.0, held[min(len(held) - 1, math.ceil(len(held) * (1 - FALSE_ALARMS)))])
    return out


def scan(spark: SparkSession, docs: DataFrame, formats: Formats, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans."""
    shared = spark.sparkContext.broadcast(formats)
    kind = docs.schema[id_col].dataType

    def make():
        known = {}

        def run(columns):
            for key, t in zip(*columns):
                t = t or ""
                base = base_spans(t)
                more = shared.value.spans(t, base, known)
                n = Counter(k for k, _, _ in base)
                yield (key, n["assign"], n["access"], n["hex"], hashlib.sha256(digest_order(base).encode()).hexdigest(),
                       digest_order(base + more), len(more))
        return run

    out = map_rows(docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text}`").cast("string")), make,
                   "id string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(spark, docs, learn(docs))
