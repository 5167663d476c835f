"""Evaluation texts leaking into training text (problem 8).

A generalised suffix automaton of the normalised words of all test items is built once; training texts are
streamed through it word by word, tracking the longest match that ends at each word. Where the match reaches
the length limit, the items that contain its last words have leaked. No shuffle of the corpus.
"""

from __future__ import annotations

import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.ship import ship, shipped
from cohortloom.sources.tables import shared_folder

#: Successive words that make a leak, share of a text's words from which the whole text goes, and the most
#: words of one automaton; more items are split over several automata that a text passes one after the other.
LEAST_WORDS, MOST_COVERED, AUTOMATON_WORDS = 12, 0.5, 250_000

# A word with what may stand inside it: marks, invisible characters, a hyphen at a line end and signs at the
# start of the next line.
_WORD = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}]|\p{Cf}(?!\s*[\r\n])|\p{Cf}*[-‐‑\u00ad¬]\p{Cf}*[ \t]*(?:\r\n|[\r\n\u0085\u2028])[ \t>*|#•·\p{Cf}-]*(?=[\p{L}\p{N}]))*")
_HYPHEN = regex.compile(r"\p{Cf}*[-‐‑\u00ad¬]\p{Cf}*[ \t]*(?:\r\n|[\r\n\u0085\u2028])[ \t>*|#•·\p{Cf}-]*")
_DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")
_PLAIN = regex.compile(r"[\p{L}\p{N}]+")
_ASCII = regex.compile(r"[a-z0-9]+")
_SYMBOLS = regex.compile(r"[\p{S}\p{P}]+")
_DIVIDED = regex.compile(r"[-‐‑\u00ad¬]\p{Cf}*[ \t]*[\r\n\u0085\u2028]")

# Letters that have no decomposition, and what they are written as without accents.
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th"})


def fold(word: str) -> list[str]:
    """Normal form of one raw word, usually one word: letter case, accents and invisible characters go."""
    if word.isascii():
        return [word.lower()]
    text = unicodedata.normalize("NFKD", word).casefold()
    text = _DROPPED.sub("", unicodedata.normalize("NFKD", text)).translate(_LETTERS)
    return _PLAIN.findall(text)


def words_of(text: str, vocabulary: set[str] | dict[str, int] | None = None, split: bool = False) -> list[str]:
    """Normalised words. A word divided by a hyphen at a line end is joined; where the vocabulary does not
    have the joined word the parts stand alone. ``split`` prefers the parts if the vocabulary has them all."""
    if not _DIVIDED.search(text):  # no division: the whole text at once gives the same words
        if text.isascii():
            return _ASCII.findall(text.lower())
        flat = unicodedata.normalize("NFKD", _SYMBOLS.sub(" ", text)).casefold()
        return _PLAIN.findall(_DROPPED.sub("", unicodedata.normalize("NFKD", flat)).translate(_LETTERS))
    out: list[str] = []
    for raw in _WORD.findall(text):
        if raw.isalnum():
            out += fold(raw)
            continue
        parts = [w for p in _HYPHEN.split(raw) for w in fold(p)]
        if len(parts) > 1:
            joined = "".join(parts)
            whole = vocabulary is None or joined in vocabulary
            if whole and not (split and all(p in vocabulary for p in parts)):
                parts = [joined]
        out += parts
    return out


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers, with the items behind each long state."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int = LEAST_WORDS):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        owners: list[set[int]] = [set() for _ in self.step]
        for item, ids in coded:
            s = 0
            for w in ids:
                s = self.step[s][w]
                t = s
                while t > 0 and item not in owners[t]:
                    owners[t].add(item)
                    t = self.link[t]
        # For a state of long strings: the items that contain its last ``least`` words.
        sets: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.found: list[tuple[int, ...]] = []
        for s in range(len(self.step)):
            t = s
            while t > 0 and self.length[self.link[t]] >= least:
                t = self.link[t]
            items = tuple(sorted(owners[t])) if self.length[s] >= least else ()
            self.found.append(sets.setdefault(items, items))
        self._pack()

    def _pack(self) -> None:
        """Most states have one way on: it goes into two arrays, only the others keep a dictionary."""
        one = [next(iter(d.items())) if len(d) == 1 else (-1, -1) for d in self.step]
        self.word, self.way = array("i", [w for w, _ in one]), array("i", [t for _, t in one])
        self.ways = {s: d for s, d in enumerate(self.step) if len(d) > 1}
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.step

    def _next(self, s: int, w: int) -> int:
        """The state after word w, -1 if there is none."""
        return self.way[s] if self.word[s] == w else self.ways[s].get(w, -1) if s in self.ways else -1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        cur = len(self.step)
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return cur

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """Position of a word, longest match ending there and leaked items, wherever that reaches the limit."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words]
        n, least = len(ids), self.least
        start = 0
        while start < n:  # only stretches of enough known words can hold a leak
            try:
                end = ids.index(-1, start)
            except ValueError:
                end = n
            if end - start >= least:
                s = l = 0
                for i in range(start, end):
                    w = ids[i]
                    nxt = self._next(s, w)
                    while s and nxt < 0:
                        s = self.link[s]
                        l = self.length[s]
                        nxt = self._next(s, w)
                    if nxt < 0:
                        s = l = 0
                        continue
                    s, l = nxt, l + 1
                    if l >= least:
                        yield i, l, self.found[s]
            start = end + 1


def automata(items: DataFrame, least: int = LEAST_WORDS, most_words: int | None = None) -> Iterator[SuffixAutomaton]:
    """Automata of the test items (item_id, item_text), one at a time. Rows with a null and items shorter than
    the limit cannot leak. Items are read one partition at a time and split by their number of words, so no
    automaton that is held or sent to the tasks exceeds ``most_words`` (AUTOMATON_WORDS) by more than an item."""
    most_words = most_words or AUTOMATON_WORDS
    part, held = [], 0
    for r in items.select("item_id", "item_text").na.drop().distinct().orderBy("item_id", "item_text").toLocalIterator():
        words = words_of(r[1])
        if len(words) < least:
            continue
        part.append((r[0], words))
        held += len(words)
        if held >= most_words:
            yield SuffixAutomaton(part, least)
            part, held = [], 0
    if part:
        yield SuffixAutomaton(part, least)


def word_forms(text: str, automaton: SuffixAutomaton) -> list[list[str]]:
    """The words of a text in each form that can match: with divided words joined, and in their parts."""
    words = words_of(text, automaton.vocabulary)
    other = words_of(text, automaton.vocabulary, split=True) if _DIVIDED.search(text) else words
    return [words] if other == words else [words, other]


def _hits(text: str, automaton: SuffixAutomaton) -> set[int]:
    found: set[int] = set()
    for words in word_forms(text, automaton):
        for _, _, items in automaton.matches(words):
            found.update(items)
    return found


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id and item_id where the document holds at least ``least`` successive words of the item.

    ``documents`` has doc_id and text, ``items`` item_id and item_text; other columns are not read. Null and
    empty texts give nothing; whole texts are read; copies of a document all count, and each row of documents
    is judged alone, so a repeated row gives its pairs again.
    """
    sc = documents.sparkSession.sparkContext
    out = None
    for automaton in automata(items, least):
        shared = ship(sc, automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shipped(shared)
            for b in batches:
                docs, found = [], []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    if text:
                        for item in sorted(_hits(text, automaton)):
                            docs.append(doc)
                            found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        part = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")


Spans = list[tuple[int, int]]


def _found_spans(text: str, automaton: SuffixAutomaton) -> Spans:
    """First and one-past-last character of each leak. The words are those that _hits matches."""
    spans: Spans = []
    if not _hits(text, automaton):
        return spans
    raws = list(_WORD.finditer(text))
    for split in (False, True):
        words, owner = [], []
        for k, m in enumerate(raws):
            for w in words_of(m.group(), automaton.vocabulary, split):
                words.append(w)
                owner.append(k)
        for i, length, _ in automaton.matches(words):
            spans.append((raws[owner[i - length + 1]].start(), raws[owner[i]].end()))
    return spans


def united(spans: Spans) -> Spans:
    """Spans in order, those that overlap or touch as one."""
    out: Spans = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(text: str, spans: Spans) -> tuple[str, list[int], list[int]]:
    """The text without united spans; where each piece that stays begins in the result and in the text."""
    pieces, begins, origins, at, n = [], [], [], 0, 0
    for a, b in [*spans, (len(text), len(text))]:
        pieces.append(text[at:a])
        begins.append(n)
        origins.append(at)
        n += a - at
        at = b
    return "".join(pieces), begins, origins


def leaked_spans(text: str, automaton: SuffixAutomaton, known: Spans = ()) -> Spans:
    """United spans of the text: the known ones, its leaks, and leaks that appear where those are cut out, so
    that nothing leaks from the text without them."""
    spans = united([*known, *_found_spans(text, automaton)])
    while spans:
        rest, begins, origins = _without(text, spans)
        new = _found_spans(rest, automaton)
        if not new:
            break

        def place(i: int) -> int:
            k = bisect_right(begins, i) - 1
            return origins[k] + i - begins[k]

        spans = united([*spans, *((place(a), place(b - 1) + 1) for a, b in new)])
    return spans


def clean_text(text: str, spans: Spans, most_covered: float = MOST_COVERED) -> tuple[int, int, str | None]:
    """Words (runs of letters and digits, divided words joined), leaked words, and the text without the united
    spans; None if they exceed the coverage limit."""
    raws = [m.start() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]
    leaked = sum(i >= 0 and a < spans[i][1] for a in raws for i in (bisect_right(starts, a) - 1,))
    if leaked > most_covered * len(raws):
        return len(raws), leaked, None
    return len(raws), leaked, _without(text, spans)[0]


def remove_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, most_covered: float = MOST_COVERED) -> DataFrame:
    """doc_id, n_words, n_leaked and clean of every document: the text without spans of at least ``least``
    leaked words, null where more than ``most_covered`` of its words leaked. Null texts stay null.

    The spans are collected with one automaton after the other, each in a pass of its own, so a task holds one;
    between passes the documents and their spans lie in the shared folder. With several automata the passes are
    repeated until no spans are added. Then the spans are cut out together.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, text string, spans array<struct<a: bigint, b: bigint>>"
    rows = documents.select("doc_id", "text", F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)").alias("spans"))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def search(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shipped(shared)
            for b in batches:
                known = [[(x["a"], x["b"]) for x in s] for s in b.column("spans").to_pylist()]
                spans = [leaked_spans(t, automaton, s) if t else [] for t, s in zip(b.column("text").to_pylist(), known)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], kind)], ["doc_id", "text", "spans"])

        return run

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            rows = [clean_text(t, [(x["a"], x["b"]) for x in s], most_covered) if t is not None else (0, 0, None) for t, s in zip(b.column("text").to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_leaked", "clean"])

    def written(df: DataFrame) -> DataFrame:
        path = f"{shared_folder(spark)}/spans"
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    covered = F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]))
    before = 0
    while True:
        n = 0
        for automaton in automata(items, least):
            rows = (written(rows) if n else rows).mapInArrow(search(ship(spark.sparkContext, automaton)), schema)
            n += 1
        if n < 2:
            break
        rows = written(rows)
        after = rows.agg(covered).head()[0] or 0
        if after == before:
            break
        before = after
    return rows.mapInArrow(clean, "doc_id bigint, n_words bigint, n_leaked bigint, clean string")
