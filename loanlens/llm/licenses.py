"""Licence scans with a generalised suffix automaton over licence tokens.

The automaton holds every token substring of all templates (licence_texts), each with all its places. A file is streamed
through it in pieces: after each token the state and the length of the longest suffix that is a template substring (the
matching statistic) are known in amortised constant time. Maximal matches of at least MIN_MATCH tokens (or a whole shorter
template) are chained, in order in both file and template and at most `gap` file tokens apart, into spans; a span that covers
at least `coverage` of its template's tokens labels the file. Base phrases are places where the matching statistic reaches
the phrase's length in a state whose strings end in the phrase.

Words are as in WORD of common. Defined results: a null or empty text has no words and no spans, score 0; a text of any length
is scanned whole, holding one piece and the open chains; of chains that cover equally much the one that starts first counts;
spans that start and end together come in the order of their labels; rows that repeat a doc_id, or have none, are scanned each
on their own; an empty table gives no rows. Only doc_id and text are read, so any further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced
from .licence_texts import TEMPLATES

# Phrases and labels of the base scan.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

MIN_MATCH = 3
#: Characters of a file that are split into words at once.
STEP = 1 << 20
#: Upper case to lower, word bytes as they are, all others to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def token_blocks(text: str | None, step: int = STEP) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece; a word over the edge of two pieces is in the later one."""
    text, open_word = text or "", b""
    for at in range(0, len(text), step):
        block = open_word + text[at : at + step].encode("utf-8", "surrogatepass").translate(_TABLE)
        words, open_word = block.split(), b""
        if words and at + step < len(text) and not block.endswith(b" "):
            open_word = words.pop()
        yield words
    if open_word:
        yield [open_word]


def tokens(text: str | None) -> list[bytes]:
    return [w for block in token_blocks(text) for w in block]


@dataclass
class Automaton:
    """Generalised suffix automaton. ends[state]: by template the last tokens (from 0) of all places of its strings."""

    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])
    sizes: list[int] = field(default_factory=list)
    vocabulary: set[bytes] = field(default_factory=set)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, token: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: bytes) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return cur

    @classmethod
    def build(cls, texts: list[str]) -> Automaton:
        a, marks = cls(), []
        for t, text in enumerate(texts):
            last, words = 0, tokens(text)
            a.sizes.append(len(words))
            a.vocabulary.update(words)
            for i, w in enumerate(words):
                last = a._extend(last, w)
                marks.append((last, t, i))
        places: list[dict[int, set[int]]] = [{} for _ in a.next]
        for state, t, i in marks:
            places[state].setdefault(t, set()).add(i)
        for state in sorted(range(1, len(a.next)), key=lambda s: -a.length[s]):
            up = places[a.link[state]]
            for t, own in places[state].items():
                up.setdefault(t, set()).update(own)
        a.ends = [{t: sorted(own) for t, own in sorted(p.items())} for p in places]
        return a

    def state_of(self, words: list[bytes]) -> int:
        """The state of a template substring."""
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def ending_in(self, strings: list[list[bytes]]) -> list[list[int]]:
        """By state the strings (template substrings) that its longest string ends in: those of the states its suffix links
        lead to."""
        out: list[list[int]] = [[] for _ in self.next]
        for k, words in enumerate(strings):
            out[self.state_of(words)].append(k)
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            out[state] = out[self.link[state]] + out[state]
        return out

    def statistics(self, blocks: Iterator[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(position, state, matching statistic) of every word that is in some template; elsewhere it is 0."""
        vocabulary, nxt, link, length = self.vocabulary, self.next, self.link, self.length
        state = matched = at = 0
        before = -2
        for words in blocks:
            for i in [i for i, w in enumerate(words) if w in vocabulary]:
                if at + i != before + 1:
                    state = matched = 0
                before, w = at + i, words[i]
                while state and w not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                state = nxt[state].get(w, 0)
                matched = matched + 1 if state else 0
                yield before, state, matched
            at += len(words)


@dataclass(frozen=True)
class Rule:
    coverage: float = 0.75
    gap: int = 6


class Chain:
    """The best chain of each group of segments of one template of `size` tokens, groups being more than gap file tokens
    apart. Segments come by file start; one may overlap the one before it, in file or template, and then counts for what
    it adds. No segment is longer than the template, so only segments of the last size + gap file tokens can come before
    one."""

    def __init__(self, size: int, gap: int):
        self.size, self.gap, self.reach = size, gap, 0
        #: (file start, covered, file start of the chain, file stop, template start, template stop)
        self.group: list[tuple[int, int, int, int, int, int]] = []

    def add(self, at: int, tem: int, n: int) -> tuple[int, int, int] | None:
        """(start, stop, tokens covered) of the best chain of the group that this segment ends, if it does."""
        done = self.close() if self.group and at > self.reach + self.gap else None
        best = (n, -at, at)
        for k in range(len(self.group) - 1, -1, -1):
            a, covered, start, stop, t, end = self.group[k]
            if at - a > self.size + self.gap:
                break
            over = max(stop - at, end - tem, 0)
            if at > a and tem > t and over < n and at <= stop + self.gap:
                best = max(best, (covered + n - over, -start, start))
        self.group.append((at, best[0], best[2], at + n, tem, tem + n))
        self.reach = max(self.reach, at + n)
        return done

    def close(self) -> tuple[int, int, int] | None:
        if not self.group:
            return None
        _, covered, start, stop, _, _ = max(self.group, key=lambda b: (b[1], -b[2], -b[3]))
        self.group, self.reach = [], 0
        return start, stop, covered


class Scanner:
    """The automaton of templates and base phrases, ready to scan texts."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES, rule: Rule = Rule()):
        self.labels = [*(x for x, _ in templates), *phrases.values()]
        self.automaton = Automaton.build([*(t for _, t in templates), *phrases])
        words = [tokens(p) for p in phrases]
        phrase = list(zip(map(len, words), phrases.values(), strict=True))
        self.phrases = [[phrase[k] for k in own] for own in self.automaton.ending_in(words)]
        self.n_templates, self.rule = len(templates), rule

    def scan(self, text: str | None, step: int = STEP) -> tuple[int, list[tuple[str, bool, int, int, float]]]:
        """Number of words, and (label, base, first word, word after the last, coverage) of every place."""
        a, rule, n_words = self.automaton, self.rule, 0
        found: list[tuple[str, bool, int, int, float]] = []
        chains: dict[int, Chain] = {}

        def blocks() -> Iterator[list[bytes]]:
            nonlocal n_words
            for words in token_blocks(text, step):
                n_words += len(words)
                yield words

        def spanned(t: int, span: tuple[int, int, int] | None) -> None:
            if span and span[2] >= rule.coverage * a.sizes[t]:
                found.append((self.labels[t], False, span[0], span[1], span[2] / a.sizes[t]))

        def maximal(i: int, state: int, n: int) -> None:
            for t, ends in a.ends[state].items():
                if t < self.n_templates and n >= min(MIN_MATCH, a.sizes[t]):
                    chain = chains.setdefault(t, Chain(a.sizes[t], rule.gap))
                    for end in ends:
                        spanned(t, chain.add(i - n + 1, end - n + 1, n))

        held = None
        for i, state, n in a.statistics(blocks()):
            if held and not (i == held[0] + 1 and n == held[2] + 1):  # the match before was maximal
                maximal(*held)
            held = (i, state, n) if n > 1 else None
            for size, label in self.phrases[state]:
                if n >= size:
                    found.append((label, True, i - size + 1, i + 1, 1.0))
        if held:
            maximal(*held)
        for t, chain in chains.items():
            spanned(t, chain.close())
        return n_words, sorted(found, key=lambda f: (f[2], f[3], f[0], not f[1]))


SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())])


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, n_words, spans) a row per row of docs; spans: array<struct<label,base,start,stop,coverage>> in words."""
    # as large as the templates are
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [shared.value.scan(t) for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("label", "base", "start", "stop", "coverage"), s, strict=True)) for s in x] for _, x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int64()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "n_words", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, spans array<struct<label:string,base:boolean,start:bigint,stop:bigint,coverage:double>>"
    )
