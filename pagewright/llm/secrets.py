"""Secret scans by grammar inference.

Three fixed patterns give the base findings. Their values in all documents are the labelled credentials: for each kind, states of
the prefix tree of the values' character classes whose outgoing frequencies are statistically compatible (Hoeffding bound) are
merged, which leaves a probabilistic automaton. The tree is never built whole: all values are read through the states found so
far, and where they leave them, what follows is counted some classes ahead; the driver gets counts alone. As loops forget
lengths, the labelled lengths are kept beside the automaton. Every candidate, a token of MIN_TOKEN characters whether a pattern has found it or not, is
scored: its log likelihood for each character under the best automaton, characters within a class being equally likely. It is
accepted if it scores as well as the labelled credentials do, and better by MARGIN than under the pairs of characters of ordinary
tokens, counted in all documents. Accepted tokens that no base finding overlaps are findings of kind `grammar`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, stored

#: The base patterns, the group that is measured, and its least length; in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", re.compile(ASSIGN, re.I | re.A), 2, 12), ("access", re.compile(ACCESS), 0, 18), ("hex", re.compile(HEX), 0, 16))
KINDS = ("assign", "access", "hex", "grammar")

#: States of an automaton at most, and by how many classes beyond a state's first its futures are compared.
STATES = 64
AHEAD = 5
#: Futures that fewer than one in this many of a kind's values reach aren't compared (those that one value reaches can't tell states apart); they are counted.
FUTURES = 1000
ALPHA = 0.05
MIN_TOKEN = 12
#: By how many nats a character a format must be likelier than ordinary text.
MARGIN = 0.5
#: Labelled lengths within this share of a token's length are like it.
NEAR = 0.125
#: How far under the worst labelled credential but one in a hundred a finding may score, in nats a character.
SLACK = 0.05

_HEX_RUN = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]{%d,}={0,2}" % MIN_TOKEN)
_WORD = re.compile(r"[A-Za-z0-9+/_.=-]{3,}")
_EDGE = "._/-"
#: The characters of tokens; number 0 is the edge of a token.
ALPHABET = "\0ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_NUMBER = {c: i for i, c in enumerate(ALPHABET)}
_CLASSES = (("0", "0123456789", 10), ("a", "abcdef", 6), ("z", "ghijklmnopqrstuvwxyz", 20), ("A", "ABCDEF", 6), ("Z", "GHIJKLMNOPQRSTUVWXYZ", 20))
_CLASS_OF = {c: name for name, chars, _ in _CLASSES for c in chars}
_SIZE = {name: size for name, _, size in _CLASSES}
_TO_CLASSES = str.maketrans(_CLASS_OF)
END = "$"


def base_matches(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base findings, by start, then kind as listed; code points, end exclusive."""
    found = []
    for kind, pattern, group, least in BASE:
        if kind == "hex":  # a run is a match, so runs that are long enough can be looked for at once
            found += [(m.start(), kind, m.end(), m[0]) for m in _HEX_RUN.finditer(text)]
        elif kind != "access" or "AKIA" in text:
            found += [(m.start(), kind, m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base findings, in that order."""
    return [m[:3] for m in base_matches(text)]


@dataclass
class Automaton:
    """A probabilistic automaton over character classes."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    count: list[dict[str, int]] = field(default_factory=lambda: [defaultdict(int)])
    lengths: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    floor: float = 0.0
    _sorted: tuple | None = field(default=None, repr=False, compare=False)

    def add(self, value: str) -> None:
        state = 0
        for c in value:
            c = _CLASS_OF.get(c, c)
            self.count[state][c] += 1
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
                self.count.append(defaultdict(int))
            state = self.next[state][c]
        self.count[state][END] += 1
        self.lengths[len(value)] += 1
        self._sorted = None

    def _near(self, n: int) -> tuple[int, int]:
        """How many labelled values have a length that n is like, and how many there are."""
        if self._sorted is None:  # lengths are settled before the first score
            own = sorted(self.lengths)
            self._sorted = own, [0, *accumulate(self.lengths[k] for k in own)]
        own, upto = self._sorted
        return upto[bisect_right(own, n / (1 - NEAR))] - upto[bisect_left(own, n / (1 + NEAR))], upto[-1]

    def score(self, value: str) -> float:
        """Log likelihood of the value, its end and its length, a character; -inf if it takes a step that no labelled value takes."""
        near, all_ = self._near(len(value))
        state, total = 0, math.log((near + 0.01) / (all_ + 0.1))
        for c in value:
            cls = _CLASS_OF.get(c, c)
            seen = self.count[state]
            n = sum(seen.values())
            total += math.log((seen.get(cls, 0) + 0.01) / (n + 0.1) / _SIZE.get(cls, 1))
            if cls not in self.next[state]:
                return -math.inf
            state = self.next[state][cls]
        seen = self.count[state]
        total += math.log((seen.get(END, 0) + 0.01) / (sum(seen.values()) + 0.1))
        return total / (len(value) + 1)


def tally(words: Iterable[tuple[str, int]], next_: list[dict[str, int]]) -> Counter:
    """How often a word of classes is read from a state, {(state, word): n}, by words (values or their classes, how many of them).

    These are single classes, END too; and where a class leads to no state yet, the words of up to AHEAD more that begin with it.
    """
    out: Counter = Counter()
    for value, n in words:
        word, state = value.translate(_TO_CLASSES) + END, 0
        for at, c in enumerate(word):
            to = next_[state].get(c)
            if to is None:
                for end in range(at + 1, min(at + 1 + AHEAD, len(word)) + 1):
                    out[state, word[at:end]] += n
                break
            out[state, c] += n
            state = to
    return out


def _compatible(outs: Mapping, next_: list[dict[str, int]], a: tuple[int, str], b: tuple[int, str]) -> bool:
    """Whether the outgoing frequencies of two places, and of those that follow, differ no more than chance allows.

    A place is a state and a word that leads out of it: the empty one for the state itself. outs: {place: {class: n}}.
    """
    follow = lambda place, c: (next_[place[0]][c], "") if not place[1] and c in next_[place[0]] else (place[0], place[1] + c)
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        x, y = outs.get(a), outs.get(b)
        if a == b or not x or not y:
            continue
        n, k = sum(x.values()), sum(y.values())
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(k))
        if any(abs(x.get(c, 0) / n - y.get(c, 0) / k) > bound for c in x.keys() | y.keys()):
            return False
        stack += [(follow(a, c), follow(b, c)) for c in (x.keys() & y.keys()) - {END}]
    return True


def grow(m: Automaton, seen: Mapping[tuple[int, str], int]) -> bool:
    """Leads classes that lead nowhere, the most frequent first, to the first compatible state; the first that has none gets a state of its own, which the rest wait for.

    seen: a tally over m. False if no class led nowhere; then m's counts are those of seen. An automaton that has all its STATES
    leads the rest to the state whose own frequencies are nearest.
    """
    outs: dict[tuple[int, str], dict[str, int]] = defaultdict(dict)
    for (state, word), n in seen.items():
        outs[state, word[:-1]][word[-1]] = n
    m.count = [dict(outs.get((state, ""), {})) for state in range(len(m.next))]
    open_ = sorted((-n, state, c) for state, own in enumerate(m.count) for c, n in own.items() if c != END and c not in m.next[state])
    for _, state, c in open_:
        into = next((kept for kept in range(len(m.count)) if _compatible(outs, m.next, (kept, ""), (state, c))), None)
        if into is None and len(m.next) < STATES:
            m.next[state][c] = len(m.next)
            m.next.append({})
            break
        m.next[state][c] = _nearest(m.count, outs.get((state, c), {})) if into is None else into
    return bool(open_)


def _nearest(count: list[dict[str, int]], own: dict[str, int]) -> int:
    share = lambda x: {c: n / max(1, sum(x.values())) for c, n in x.items()}
    b = share(own)
    away = [sum(abs(a.get(c, 0) - b.get(c, 0)) for c in a.keys() | b.keys()) for a in map(share, count)]
    return away.index(min(away))


def merge(automata: dict[str, Automaton], read: Callable[[], Mapping[str, Mapping[tuple[int, str], int]]]) -> None:
    """Grows each kind's automaton until all its classes lead to states; read: the tallies of all over what they are now. It is called once for each state of the largest and once or twice more."""
    growing = True
    while growing:
        seen = read()
        growing = any([grow(m, seen.get(kind, {})) for kind, m in automata.items()])


def thousandths(m: Automaton, words: Iterable[tuple[str, int]]) -> Counter:
    """How many words have a score, in thousandths, rounded down."""
    out: Counter = Counter()
    for word, n in words:
        out[math.floor(1000 * m.score(word))] += n
    return out


def set_floor(m: Automaton, scores: Mapping[int, int]) -> None:
    """The floor under the score that one in a hundred is worse than."""
    left = sum(scores.values()) // 100
    for score in sorted(scores):
        left -= scores[score]
        if left < 0:
            m.floor = score / 1000 - SLACK
            return
    m.floor = math.inf


def infer(values: Iterable[str]) -> Automaton:
    """The automaton of values at hand."""
    words = sorted(Counter(values).items())
    m = Automaton()
    merge({"": m}, lambda: {"": tally(words, m.next)})
    for word, n in words:
        m.lengths[len(word)] += n
    set_floor(m, thousandths(m, words))
    return m


class Background:
    """Pairs of characters in ordinary tokens."""

    def __init__(self, counts: np.ndarray):
        """counts: of each character of ALPHABET followed by each."""
        n = len(ALPHABET)
        self.counts = counts
        self.log = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * n)).tolist()

    def score(self, value: str) -> float:
        """Log likelihood of the value and its end, a character."""
        last, total = 0, 0.0
        for c in value:
            now = _NUMBER[c]
            total += self.log[last][now]
            last = now
        return (total + self.log[last][0]) / (len(value) + 1)


#: Bytes of tokens whose pairs are counted at once.
SLICE = 1 << 20


def pair_counts(text: str, counts: np.ndarray, base: list | None = None) -> None:
    """Adds the pairs of characters of a text's tokens that no base finding (start, kind, end) overlaps."""
    base = base_spans(text) if base is None else base
    words = [m[0] for m in _WORD.finditer(text) if not base or not _overlaps(m.start(), m.end(), base)]
    if words:
        joined_ = np.frombuffer(("\0" + "\0".join(words) + "\0").encode(), np.uint8)
        for at in range(0, len(joined_) - 1, SLICE):
            x = _BYTE_NUMBER[joined_[at : at + SLICE + 1]]
            counts += np.bincount(x[:-1] * len(ALPHABET) + x[1:], minlength=counts.size).reshape(counts.shape)


_BYTE_NUMBER = np.zeros(256, np.int64)
for _c, _i in _NUMBER.items():
    _BYTE_NUMBER[ord(_c)] = _i


def _overlaps(start: int, end: int, spans: list[tuple[int, str, int]]) -> bool:
    return any(s < end and start < e for s, _, e in spans)


class Grammars:
    """The automata and the background, and findings in texts."""

    def __init__(self, automata: dict[str, Automaton], background: Background | None = None):
        self.automata = automata
        self.background = background or Background(np.zeros((len(ALPHABET),) * 2))
        self._likely = lru_cache(maxsize=100_000)(self._scores_well)

    def __reduce__(self):
        return Grammars, (self.automata, self.background)

    def _scores_well(self, token: str) -> bool:
        best = max((m.score(token) for m in self.automata.values() if m.floor < math.inf), default=-math.inf)
        good = any(m.score(token) >= m.floor for m in self.automata.values())
        return good and best >= self.background.score(token) + MARGIN

    def accepted(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every token that scores well, whether a pattern finds it or not."""
        found = []
        for m in _TOKEN.finditer(text):
            token = m[0]
            bare = token.lstrip(_EDGE)
            start = m.end() - len(bare)
            bare = bare.rstrip(_EDGE)
            if len(bare) >= MIN_TOKEN and self._likely(bare):
                found.append((start, start + len(bare)))
        return found

    def findings(self, text: str) -> tuple[list[tuple[int, str, int]], int]:
        """(base_spans and the accepted tokens that none of them overlaps, how many base findings an accepted token overlaps)."""
        base = base_spans(text)
        own = self.accepted(text) if self.automata else []
        more = [(start, "grammar", end) for start, end in own if not _overlaps(start, end, base)]
        confirmed = sum(any(s < end and start < e for start, end in own) for s, _, e in base) if own else 0
        return (sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]))) if more else base), confirmed

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        return self.findings(text)[0]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def learn(docs: DataFrame) -> Grammars:
    """Grammars from the base values of all documents, and the pairs of characters of all other tokens there.

    Null texts count as none, a repeated value once; without any there are no grammars. The values stay in Spark, as words of
    classes; the driver gets counts, as many as states, classes and FUTURES allow, lengths and rounded scores.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ALPHABET),) * 2, np.int64)
        for batch in batches:
            pairs = set()
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_matches(text)
                    pair_counts(text, counts, [m[:3] for m in base])
                    pairs |= {(m[1], m[3]) for m in base}
            yield _record([(kind, value, 0) for kind, value in sorted(pairs)], "kind", "value", "n")
        yield _record([("pair", ALPHABET[a] + ALPHABET[b], int(counts[a, b])) for a, b in np.argwhere(counts).tolist()], "kind", "value", "n")

    found = docs.select(F.col("text").cast("string")).mapInArrow(collect, "kind string, value string, n long")
    found = stored(found.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    chars = "".join(_CLASS_OF)
    words = found.where("kind <> 'pair'").select("kind", F.translate("value", chars, chars.translate(_TO_CLASSES)).alias("word"))
    words = stored(words.groupBy("kind", "word").agg(F.count("*").alias("n")))
    automata: dict[str, Automaton] = defaultdict(Automaton)
    for r in words.groupBy("kind", F.length("word").alias("length")).agg(F.sum("n").alias("n")).collect():
        automata[r.kind].lengths[r.length] = r.n
    automata = {kind: automata[kind] for kind in KINDS if kind in automata}
    if automata:
        merge(automata, lambda: _tallies(words, automata))
        scored = _each_kind(words, {k: (lambda w, m=m: [(str(s), n) for s, n in thousandths(m, w).items()]) for k, m in automata.items()})
        scores: dict[str, dict[int, int]] = defaultdict(dict)
        for r in scored.groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
            scores[r.kind][int(r.key)] = r.n
        for kind, m in automata.items():
            set_floor(m, scores[kind])
    counts = np.zeros((len(ALPHABET),) * 2)
    for r in found.where("kind = 'pair'").collect():  # ALPHABET squared rows at most
        counts[_NUMBER[r.value[0]], _NUMBER[r.value[1]]] = r.n
    return Grammars(automata, Background(counts))


def _record(rows: list[tuple[str, str, int]], *names: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=list(names))


def _each_kind(words: DataFrame, count: Mapping[str, Callable[[Iterable[tuple[str, int]]], list[tuple[str, int]]]]) -> DataFrame:
    """(kind, key, n): what each kind's function counts in its words (kind, word, n), a batch at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = defaultdict(list)
            for kind, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own[kind].append((word, n))
            yield _record([(kind, key, n) for kind, w in own.items() for key, n in count[kind](w)], "kind", "key", "n")

    return words.select("kind", "word", "n").mapInArrow(read, "kind string, key string, n long")


def _tallies(words: DataFrame, automata: Mapping[str, Automaton]) -> dict[str, dict[tuple[int, str], int]]:
    """The tally of each kind over all words; places that too few words reach to tell states apart are left out whole."""
    read = {k: (lambda w, own=m.next: [(f"{state} {word}", n) for (state, word), n in tally(w, own).items()]) for k, m in automata.items()}
    rows = _each_kind(words, read).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    place = F.expr("substring(key, 1, length(key) - 1)")
    least = F.element_at(F.create_map(*(F.lit(x) for k, m in automata.items() for x in (k, max(2, sum(m.lengths.values()) // FUTURES)))), F.col("kind"))
    reached = F.sum("n").over(Window.partitionBy("kind", place))
    out: dict[str, dict[tuple[int, str], int]] = {k: {} for k in automata}
    for r in rows.withColumn("reached", reached).where(place.endswith(" ") | (F.col("reached") >= least)).collect():
        state, word = r.key.split(" ")
        out[r.kind][int(state), word] = r.n
    return out


def scan(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar, n_confirmed), a row for each row of docs (doc_id, text, ...).

    n_grammar counts the findings that the grammars add, n_confirmed the base findings that they accept, too.

    A null text counts as empty. Rows that repeat stay; an empty table gives none. Without labelled credentials there are no
    grammars, and the base findings are all.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(grammars)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans, confirmed = own.findings(text or "")
                base = [s for s in spans if s[1] != "grammar"]
                kinds = [s[1] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), confirmed))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar", "n_confirmed"]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long, n_confirmed long")


def secrets(docs: DataFrame) -> DataFrame:
    """Learns grammars from docs and scans every row; cases as in scan."""
    return scan(docs, learn(docs))


def redacted(docs: DataFrame, grammars: Grammars, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every finding in text replaced by mark (overlapping ones together), and n_chars, if there is one, counted anew where text changed.

    A null text stays null; all rows and columns stay, repeated rows, too.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(grammars)

    @F.pandas_udf("string")
    def clean(texts):
        own = shared.value

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, _, end in own.spans(text):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join(out) + text[at:]

        return texts.map(one)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
