"""Missing or wrong language labels and mixed texts (problem 9).

Script ranges narrow the candidate languages of each word; a character n-gram and word model gives each word
a score for each candidate; Viterbi with a switching penalty labels spans. Spans too short for a sentence join
their neighbours. The model is fitted on a small table of labelled sentences.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.ship import ship, shipped

# Codes and names of each language, lower case.
ALIASES = {
    "en": "en eng english englisch anglais inglés ingles inglese inglês engels angielski английский",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco alemão duits niemiecki немецкий",
    "fr": "fr fra fre french français francais französisch francés francese francês frans francuski французский",
    "es": "es spa esp spanish español espanol spanisch espagnol castellano spagnolo espanhol spaans hiszpański испанский",
    "it": "it ita italian italiano italienisch italien italiaans włoski итальянский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees portugalski португальский",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais holandés olandese holandês niderlandzki нидерландский голландский flemish vlaams",
    "pl": "pl pol polish polski polnisch polonais polaco polacco polonês pools польский",
    "ru": "ru rus russian русский russisch russe ruso russo rosyjski",
}

# Ranges of scripts that separate candidate languages.
SCRIPTS = {"latin": r"\p{Latin}", "cyrillic": r"\p{Cyrillic}", "greek": r"\p{Greek}", "arabic": r"\p{Arabic}", "hebrew": r"\p{Hebrew}", "han": r"\p{Han}", "kana": r"[\p{Hiragana}\p{Katakana}]", "hangul": r"\p{Hangul}"}

#: Words, and what ends a sentence.
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*|[.!?…。]+(?=\s|$)|[\r\n\u0085\u2028\u2029]+")
_MARKS = regex.compile(r"\p{M}+")


@dataclass(frozen=True)
class Params:
    """Parameters, the same for every size of data.

    samples: most labelled sentences the model is fitted on. longest: n-gram length. clip: the most a word
    can speak against a language. damp: weight of the summed n-gram evidence. inside and boundary: penalty of
    a switch inside a sentence and at its end. least_words: words a passage needs. texts: texts at a time.
    """

    samples: int = 20_000
    longest: int = 5
    clip: float = 4.0
    damp: float = 0.35
    inside: float = 13.0
    boundary: float = 8.0
    least_words: int = 5
    texts: int = 1_000


@dataclass
class Model:
    languages: list[str]
    params: Params
    grams: dict[str, np.ndarray] = field(default_factory=dict)
    default: np.ndarray | None = None
    scripts: dict[str, list[int]] = field(default_factory=dict)
    calibration: tuple[float, ...] = (0.0, 1.0, 1.0, 0.0, 1.0)

    def confidence(self, margin: float, words: int) -> float:
        """Probability that a passage has its language: a logistic function of the mean evidence of its words
        against the best other language and of their number, fitted on held-out sentences and at most what
        their number can show."""
        base, mean, size, both, most = self.calibration
        n = math.log(max(words, 1))
        x = base + mean * margin + size * n + both * margin * n
        return min(most, 1 / (1 + math.exp(-min(30.0, max(-30.0, x)))))

    def features(self, word: str) -> list[str]:
        w = f"^{word}$"
        out = [w + w] if len(word) > 1 else []
        for n in range(1, self.params.longest + 1):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
        return out

    def score(self, word: str) -> np.ndarray:
        """Log evidence of a lower-case word for each language, 0 for the best, at least -clip."""
        p = self.params
        out = np.full(len(self.languages), -p.clip)
        near = None
        for script, pattern in _PATTERNS.items():
            if pattern.search(word):
                near = self.scripts.get(script)
                break
        if not near:
            return np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        for f in self.features(word):
            g = self.grams.get(f)
            if g is not None:
                total += g
        best = total[near].max()
        out[near] = np.maximum(-p.clip, p.damp * (total[near] - best))
        return out


_PATTERNS = {k: regex.compile(v) for k, v in SCRIPTS.items()}


def words_in(text: str) -> list[str]:
    """The words of a text in lower case."""
    return [t for t in _TOKEN.findall(unicodedata.normalize("NFC", text).lower()) if t[0].isalpha()]


def plain(word: str) -> str:
    """A word as it looks without accents."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", word)).replace("ł", "l").replace("ß", "ss").replace("ø", "o")


def train(rows: list[tuple[str, str]], params: Params = Params()) -> Model:
    """Model of (language, sentence) rows. Every word counts as written and without its accents, so texts that
    lost them score too. Evidence of a feature is its smoothed log share in a language against the mean."""
    languages = sorted({lang for lang, _ in rows})
    model = Model(languages, params)
    at = {lang: i for i, lang in enumerate(languages)}
    counts: dict[str, Counter] = defaultdict(Counter)
    words: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for word in words_in(text):
            words[lang][word] += 2
            words[lang][plain(word)] += 1
    scripts: dict[str, Counter] = defaultdict(Counter)
    for lang, ws in words.items():
        for w, n in ws.items():
            weight = math.sqrt(n)
            for f in model.features(w):
                counts[lang][f] += weight
            for s, pattern in _PATTERNS.items():
                if pattern.search(w):
                    scripts[s][lang] += n
                    break
    # A language is a candidate of a script if a fair share of its words is written in it.
    model.scripts = {s: sorted(at[lang] for lang, n in c.items() if n > 0.2 * sum(words[lang].values())) for s, c in scripts.items()}
    every = {f for c in counts.values() for f in c}
    total = np.array([sum(counts[lang].values()) for lang in languages])
    for f in every:
        n = np.array([counts[lang][f] for lang in languages])
        share = np.log((n + 0.3) / (total + 0.3 * 1000))
        model.grams[f] = np.maximum(share - share.max(), -6.0)
    return model


def prefixes(rows: list[tuple[str, str]], model: Model) -> list[tuple[str, str, float, int]]:
    """Language, found language, mean evidence against the best other one, and number of words of the first 1,
    2, 3, 4, 6, 8 ... words of each sentence: what the confidence is fitted on and tested with."""
    out = []
    for lang, text in rows:
        words = words_in(text)
        sizes = {n for n in (1, 2, 3, 4, 6, 8, 12, 16, 24) if n < len(words)} | {len(words)}
        total = np.cumsum([model.score(w) for w in words], axis=0) if words else np.zeros((0, 0))
        for n in sorted(sizes - {0}):
            best, other = np.argsort(-total[n - 1], kind="stable")[:2] if len(model.languages) > 1 else (0, 0)
            out.append((lang, model.languages[best], float(total[n - 1][best] - total[n - 1][other]) / n, n))
    return out


def calibrate(rows: list[tuple[str, str]], params: Params = Params()) -> tuple[float, ...]:
    """Coefficients of Model.confidence: every third sentence of each language is held out of a model of the
    rest, and a logistic function is fitted to which of its prefixes get the right language."""
    rows = sorted(rows)
    held, rest = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    if len({lang for lang, _ in rest}) < 2:
        return Model([], params).calibration
    seen = prefixes(held, train(rest, params))
    if not seen:
        return Model([], params).calibration
    x = np.array([[1.0, m, math.log(n), m * math.log(n)] for _, _, m, n in seen])
    y = np.array([lang == found for lang, found, _, _ in seen], float)
    w = np.zeros(4)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return (*w.tolist(), 1 - 1 / (len(seen) + 2))


def model_of(samples: DataFrame, params: Params = Params()) -> Model:
    """Fit on labelled sentences (lang, sample_text): at most params.samples rows, ordered by text, so the
    model has a bounded size. The confidence is calibrated on held-out ones of them."""
    rows = samples.select(F.lower(F.trim("lang")).alias("lang"), "sample_text").na.drop().filter("lang <> ''").orderBy(F.xxhash64("sample_text"), "sample_text", "lang").limit(params.samples).collect()
    pairs = [(r[0], r[1]) for r in rows]
    model = train(pairs, params)
    model.calibration = calibrate(pairs, params)
    return model


def label_language(label: str | None, languages: list[str]) -> str | None:
    """The language a label names, by code, name or regional form; None if it names none of them."""
    if not label:
        return None
    low = label.strip().lower()
    for form in (low, regex.split(r"[-_\s(,;/.]", low)[0]):
        if form in languages:
            return form
        for lang, names in ALIASES.items():
            if form in names.split() and lang in languages:
                return lang
    return None


def viterbi(scores: np.ndarray, penalty: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best language of each word of many texts at once: scores (texts, words, languages), penalty (texts,
    words) of a switch before the word, lengths of the texts, longest first."""
    n, t, k = scores.shape
    stay = np.zeros((n, t, k), bool)
    top = np.zeros((n, t), np.int16)
    best = scores[:, 0].copy()
    for i in range(1, t):
        m = int(np.searchsorted(-lengths, -i, side="left"))  # texts longer than i
        b = best[:m]
        lead = b.argmax(1)
        change = b[np.arange(m), lead] - penalty[:m, i]
        keep = b >= change[:, None]
        best[:m] = np.where(keep, b, change[:, None]) + scores[:m, i]
        stay[:m, i], top[:m, i] = keep, lead
    path = np.zeros((n, t), np.int16)
    state = best.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, -1, -1):
        m = int(np.searchsorted(-lengths, -i, side="left"))
        path[:m, i] = state[:m]
        if i:
            r = rows[:m]
            state[:m] = np.where(stay[r, i, state[:m]], state[:m], top[:m, i])
    return path


def _spans(path: np.ndarray, scores: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Spans (first word, one past the last, language). Spans of fewer than ``least`` words that speak for any
    language join the better of their neighbours; a text too short for one span takes its best language."""
    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
    spans = [(a, b, int(path[a])) for a, b in zip(cuts, cuts[1:])]
    telling = np.append(0, np.cumsum(scores.min(1) < -0.5))
    size = lambda s: telling[s[1]] - telling[s[0]]
    while len(spans) > 1:
        i = min(range(len(spans)), key=lambda j: (size(spans[j]), j))
        if size(spans[i]) >= least:
            break
        a, b, _ = spans[i]
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(spans)]
        j = max(near, key=lambda j: (scores[a:b, spans[j][2]].sum(), size(spans[j])))
        lo, hi = min(i, j), max(i, j)
        spans[lo : hi + 1] = [(spans[lo][0], spans[hi][1], spans[j][2])]
        k = 1
        while k < len(spans):
            if spans[k - 1][2] == spans[k][2]:
                spans[k - 1 : k + 1] = [(spans[k - 1][0], spans[k][1], spans[k][2])]
            else:
                k += 1
    return spans


def label_texts(texts: list[str | None], model: Model, memo: dict[str, int], table: list[np.ndarray]) -> list[list[tuple[str, int, float]]]:
    """Passages (language, words, confidence) of each text in order; none for a text without words.

    memo and table keep the scores of words already seen. For the confidence see Model.confidence.
    """
    p = model.params
    k = len(model.languages)
    ids: list[np.ndarray] = []
    pens: list[np.ndarray] = []
    for text in texts:
        tokens = _TOKEN.findall(unicodedata.normalize("NFC", text).lower()) if text else []
        numbers = list(map(memo.get, tokens))
        if None in numbers:
            for t in tokens:
                if t not in memo:
                    if t[0].isalpha():
                        memo[t] = len(table)
                        table.append(model.score(t))
                    else:
                        memo[t] = -1  # the end of a sentence
            numbers = list(map(memo.get, tokens))
        n = np.array(numbers, np.int64)
        ends = n < 0
        ids.append(n[~ends])
        pens.append(np.where(np.concatenate(([True], ends[:-1])), p.boundary, p.inside)[~ends] if len(n) else np.zeros(0))
    score_of = np.array(table) if table else np.zeros((1, k))
    lengths = np.array([len(r) for r in ids], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    out: list[list[tuple[str, int, float]]] = [[] for _ in texts]
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        group = order[at : at + max(1, min(512, 400_000 // (longest * k)))]
        at += len(group)
        scores = np.zeros((len(group), longest, k))
        penalty = np.full((len(group), longest), p.inside)
        for g, doc in enumerate(group):
            scores[g, : lengths[doc]] = score_of[ids[doc]]
            penalty[g, : lengths[doc]] = pens[doc]
        path = viterbi(scores, penalty, lengths[group])
        for g, doc in enumerate(group):
            n = int(lengths[doc])
            s = scores[g, :n]
            passages = []
            for a, b, lang in _spans(path[g, :n], s, p.least_words):
                evidence = s[a:b].sum(0)
                margin = evidence[lang] - max((evidence[j] for j in range(k) if j != lang), default=0.0)
                passages.append((model.languages[lang], b - a, model.confidence(margin / (b - a), b - a)))
            out[doc] = passages
    return out


def passages(documents: DataFrame, samples: DataFrame, params: Params = Params()) -> DataFrame:
    """Every passage of every document: doc_id, seg, n_segs, lang, n_words, confidence, label_lang.

    ``documents`` has doc_id, text and lang; ``samples`` lang and sample_text. seg counts from 1. label_lang
    is the language that the document's label names, null if none. A text without words gives no row; null
    texts neither; whole texts are read; repeated rows each give theirs. No samples give no rows. No shuffle;
    the model is broadcast, its size is bounded by params.samples.
    """
    model = model_of(samples, params)
    shared = ship(documents.sparkSession.sparkContext, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped(shared)
        memo: dict[str, int] = {}
        table: list[np.ndarray] = []
        labels: dict[str | None, str | None] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, model.params.texts):
                part = batch.slice(k, model.params.texts)
                if len(memo) > 200_000:
                    memo, table = {}, []
                if len(labels) > 10_000:
                    labels = {}
                found = label_texts(part.column("text").to_pylist(), model, memo, table) if model.languages else []
                rows = []
                for doc, label, spans in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), found):
                    if label not in labels:
                        labels[label] = label_language(label, model.languages)
                    named = labels[label]
                    rows += [(doc, i, len(spans), lang, n, c, named) for i, (lang, n, c) in enumerate(spans, 1)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], ["doc_id", "seg", "n_segs", "lang", "n_words", "confidence", "label_lang"])

    return documents.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, seg bigint, n_segs bigint, lang string, n_words bigint, confidence double, label_lang string")


def corrections(found: DataFrame) -> DataFrame:
    """Of the passages: all of documents in several languages, and documents in one language whose label is
    missing or names another one."""
    return found.filter((F.col("n_segs") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")))
