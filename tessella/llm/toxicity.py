"""Operator 9: toxicity by a lexicon trie, Levenshtein automata and context windows.

Fitting: from at most ``TRAIN_ROWS`` labelled rows, never from the held-out ones, terms are learned that
significantly more toxic than other documents contain: whole words and stems (word beginnings).
Spelling variants of the whole words that ordinary training documents use are learned as benign.
A logistic model over four features of the hits then gives the score.

Scoring: a word hits if it is a lexicon word, begins with a lexicon stem, or is a misspelling: the
Levenshtein automaton of the word, intersected with the trie of all learned words and stems, accepts a
term within one edit (two from ten letters on; words of under four letters are not searched), in the first letter as in others.  The automaton runs on the
words that share a form with a term after as many deletions, which every misspelling does.  Letter-like digits and signs are folded.  Each hit is weighed by the
window of words around it: inside quotation marks or beside words of reporting it counts
``QUOTED`` of its weight.  Scores come from the text alone; every word of every text is read.

The fitted model is a few thousand terms at most (``MAX_TERMS``) and travels inside the function.
A null text is an empty one; its score is that of no hit.  Without labelled rows of both kinds all
scores are 0.  Repeated ids are scored row by row; labels that disagree count as toxic; null labels
are left out.  Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.words import mix

TRAIN_ROWS, MAX_TERMS, MEMO_WORDS = 8_000, 4_000, 500_000
HELD_TERMS = 300_000
TOGETHER = 1 << 19
STEMS = (4, 5, 6, 7)
CUT, QUOTED, WINDOW = 0.3, 0.35, 6
_run = re.compile(r"(.)\1{2,}")
_word = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*")
# Signs that stand for letters, quotation marks, words of reporting.
LEET = str.maketrans("013457@$!", "oieastasi")
QUOTES = frozenset("\"'“”„«»‘’")
REPORTING = frozenset("said says wrote quoted quote called quotes writes term word insult insults slur".split())


def tokens(text: str) -> list[str]:
    """Lower-case words."""
    return _word.findall(text.lower())


def fold(word: str) -> str:
    """A word that mixes letters with letter-like signs, in letters."""
    return word if word.isalpha() or not any(c.isalpha() for c in word) else word.translate(LEET)


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)


def _falling(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def deletion_hashes(words: list[str], k: int) -> np.ndarray:
    """Of words of one length: 64-bit hashes of the word and of what is left of it after up to ``k`` (0 to 2) deletions, a row a
    word.  Words within ``k`` edits of each other share one of these; equal strings have equal hashes."""
    n = len(words[0])
    letters = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
    total = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(mix(letters + np.uint64(1)) * _falling(n, _BASE), axis=1, out=total[:, 1:])
    back, end = [np.uint64(pow(_BACK, d, 2**64)) for d in range(3)], total[:, -1:]
    out = [end]
    if k:
        out.append(total[:, :-1] + (end - total[:, 1:]) * back[1])
    if k > 1:
        i, j = np.triu_indices(n, 1)
        out.append(total[:, i] + (total[:, j] - total[:, i + 1]) * back[1] + (end - total[:, j + 1]) * back[2])
    return mix(np.concatenate(out, axis=1))


def by_length(words) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


class Near:
    """Which words share a form with a term after up to ``k`` deletions each."""

    def __init__(self, terms, k: int):
        self.k = k
        found = [deletion_hashes(ws, min(k, n)).ravel() for n, ws in by_length(terms).items() if n]
        self.forms = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.forms >> np.uint64(42)).astype(np.int64)] = True

    def of(self, words: list[str]) -> list[str]:
        """``words``: of one length."""
        hashes = deletion_hashes(words, self.k)
        row, column = np.nonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        if not len(row):
            return []
        x = hashes[row, column]
        at = np.minimum(np.searchsorted(self.forms, x), len(self.forms) - 1)
        return [words[i] for i in np.unique(row[self.forms[at] == x]).tolist()]


def edits(word: str) -> int:
    return 2 if len(word) >= 10 else 1


class Trie:
    """Lexicon words as nested dictionaries; the key "" ends a word."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w


class Levenshtein:
    """The automaton of one word: states are rows of edit distances, cut off above ``k``."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple:
        return tuple(min(i, self.k + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple, c: str) -> tuple:
        row = [min(state[0] + 1, self.k + 1)]
        for i, x in enumerate(self.word):
            row.append(min(row[i] + 1, state[i] + (x != c), state[i + 1] + 1, self.k + 1))
        return tuple(row)

    def alive(self, state: tuple) -> bool:
        return min(state) <= self.k

    def accepted(self, trie: Trie, anywhere: bool = False) -> str | None:
        """The first lexicon word that both accept; words share their first letter, unless edits may be ``anywhere``."""
        if anywhere:
            todo = [(trie.root, self.start())]
        else:
            node = trie.root.get(self.word[:1])
            if node is None:
                return None
            todo = [(node, self.step(self.start(), self.word[0]))]
        while todo:
            node, state = todo.pop()
            if "" in node and state[-1] <= self.k:
                return node[""]
            for c, below in node.items():
                if c and self.alive(after := self.step(state, c)):
                    todo.append((below, after))
        return None


@dataclass
class Model:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()
    benign: frozenset = frozenset()
    #: Words that a stem covers: they hit by it, and their misspellings by themselves.
    family: frozenset = frozenset()
    mean: tuple = (0.0,) * 4
    scale: tuple = (1.0,) * 4
    weights: tuple = (0.0,) * 5
    fitted: bool = False
    trie: Trie | None = field(default=None, repr=False)
    #: By the number of edits: the terms' forms after as many deletions or fewer.
    near: dict = field(default_factory=dict, repr=False)
    longest: int = 0

    def prepared(self) -> Model:
        terms = self.words | self.family | self.stems
        self.trie = Trie(terms)
        self.longest = max(map(len, terms), default=0)
        self.near = {k: Near(terms, k) for k in (1, 2)}
        return self


class Scorer:
    def __init__(self, model: Model):
        self.m = model.prepared()
        #: Words weighed so far, and those of them that hit, with their weights.
        self.seen: set[str] = set()
        self.hot: dict[str, float] = {}

    def weigh(self, words: list[str]) -> dict[str, float]:
        """The weights of those folded words that hit."""
        m, out, unknown = self.m, {}, []
        for w in words:
            if w in m.words or (m.stems and any([w[:k] in m.stems for k in STEMS])):
                out[w] = 1.0
            elif w in m.benign:
                continue
            elif _run.search(w) and _run.sub(r"\1", w) in m.words:
                out[w] = 0.7
            elif 4 <= len(w) <= m.longest + edits(w):
                unknown.append(w)
        # Words that share no form with a term after as many deletions as edits are allowed need no automaton.
        for n, group in by_length(unknown).items():
            for lo in range(0, len(group), 2048):
                k = edits(group[lo])
                for w in m.near[k].of(group[lo : lo + 2048]):
                    if Levenshtein(w, k).accepted(m.trie, anywhere=True):
                        out[w] = 0.7
        return out

    def learn(self, words: set[str]) -> None:
        """Weighs those of the words that are not known yet."""
        fresh = words - self.seen
        if len(self.seen) + len(fresh) > MEMO_WORDS:
            self.seen, self.hot, fresh = set(), {}, words
        folded = {w: fold(w) for w in fresh}
        weights = self.weigh(list(set(folded.values())))
        if weights:
            self.hot |= {w: weights[f] for w, f in folded.items() if f in weights}
        self.seen |= fresh

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        distinct = set(words)
        if not distinct <= self.seen:
            self.learn(distinct)
        hot = self.hot
        return [] if hot.keys().isdisjoint(distinct) else [(i, hot[w]) for i, w in enumerate(words) if w in hot]

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Weighted hits, hits per hundred words, most in one window, share in quotation."""
        return self._features(text, tokens(text))

    def all_features(self, texts: list[str]) -> Iterator[tuple[float, float, float, float]]:
        """``features`` of each text; the words of about ``TOGETHER`` characters of text are weighed at once."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TOGETHER):
                size += len(texts[hi])
                hi += 1
            words = [tokens(t) for t in texts[lo:hi]]
            self.learn(set().union(*words))
            yield from map(self._features, texts[lo:hi], words)
            lo = hi

    def _features(self, text: str, words: list[str]) -> tuple[float, float, float, float]:
        hits = self.hits(words)
        if not hits:
            return 0.0, 0.0, 0.0, 0.0
        where = self._quoted(text, words, hits)
        weights = [w * (QUOTED if q else 1.0) for (_, w), q in zip(hits, where, strict=True)]
        most, lo, run = 0.0, 0, 0.0
        for hi, (i, _) in enumerate(hits):
            run += weights[hi]
            while hits[lo][0] < i - 2 * WINDOW:
                run -= weights[lo]
                lo += 1
            most = max(most, run)
        total = sum(weights)
        return math.log1p(total), math.log1p(100 * total / len(words)), math.log1p(most), sum(where) / len(hits)

    @staticmethod
    def _quoted(text: str, words: list[str], hits: list[tuple[int, float]]) -> list[bool]:
        """Of each hit, whether its window reports instead of abusing: quotation marks on both sides
        of it, within the window, or a word of reporting before it."""
        starts = None
        out = []
        marked = any(q in text for q in QUOTES)
        for i, _ in hits:
            said = any(w in REPORTING for w in words[max(0, i - WINDOW) : i])
            if not said and marked:
                if starts is None:
                    text = text.lower()
                    starts = [(m.start(), m.end()) for m in _word.finditer(text)]
                if starts:
                    a, b = starts[max(0, i - WINDOW)][0], starts[min(len(starts) - 1, i + WINDOW)][1]
                    before, after = text[a : starts[i][0]], text[starts[i][1] : b]
                    opened = any(c in QUOTES and (k == 0 or not before[k - 1].isalnum()) for k, c in enumerate(before))
                    said = opened and any(c in QUOTES and (k + 1 == len(after) or not after[k + 1].isalnum()) for k, c in enumerate(after))
            out.append(said)
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        m = self.m
        if not m.fitted:
            return [0.0] * len(texts)
        parts = list(zip(m.weights[1:], m.mean, m.scale, strict=True))
        sums = (m.weights[0] + sum(w * (v - a) / s for v, (w, a, s) in zip(x, parts, strict=True)) for x in self.all_features([t or "" for t in texts]))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in sums]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, toxic, n): documents of each label that have the term, summed over the task's batches
    as far as ``HELD_TERMS`` entries allow."""
    held: Counter = Counter()

    def made() -> pa.RecordBatch:
        keys = list(held)
        columns = list(zip(*keys, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*columns, tuple(held.values())), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["kind", "term", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {fold(w) for w in set(tokens(text or "")) if 3 <= len(w) <= 40}
            held.update(("w", w, toxic) for w in words)
            held.update({("s", w[:k], toxic) for w in words for k in STEMS if len(w) > k})
            if len(held) > HELD_TERMS:
                yield made()
                held.clear()
    yield made()


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out quarter, chosen by a hash of the id."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(train: DataFrame) -> Model:
    """Lexicon, benign variants and logistic model from ``train(text, toxic)``."""
    train = store.written(train, "train")
    n = train.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    total, toxic = n["n"], n["t"] or 0
    if not toxic or toxic == total:
        return Model()
    base = toxic / total
    counted = train.mapInArrow(_terms, "kind string, term string, toxic int, n int").groupBy("kind", "term").agg(F.sum(F.col("toxic") * F.col("n")).alias("t"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("o"))
    counted = store.written(counted, "terms").withColumn("n", F.col("t") + F.col("o"))
    ln = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (F.col("n") * p))).otherwise(0.0)
    found = counted.filter(f"t >= 3 and t >= 0.85 * n and n < {0.5 * total}").withColumn("gain", ln("t", base) + ln("o", 1 - base)).filter("gain >= 14")
    kept = found.orderBy(F.desc("gain"), "kind", "term").limit(MAX_TERMS).collect()
    words = {r.term for r in kept if r.kind == "w"}
    # A stem stands for a family of words: no single word may make up most of its documents.
    spelt = counted.filter("kind = 'w'").select("term", "t", F.explode(F.array(*[F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEMS])).alias("stem"))
    single = {r.stem: r.most for r in spelt.join(F.broadcast(found.filter("kind = 's'").orderBy(F.desc("gain"), "term").limit(MAX_TERMS).select(F.col("term").alias("stem"))), "stem").groupBy("stem").agg(F.max("t").alias("most")).collect()}
    stems = {r.term for r in kept if r.kind == "s" and r.t >= 2 * single.get(r.term, r.t)}
    # It stays for its shortest form, and the words it covers need no entry.
    stems = {s for s in stems if not any(s[:k] in stems for k in STEMS if k < len(s))}
    family = frozenset(w for w in words if any(w[:k] in stems for k in STEMS if len(w) > k))
    model = Model(words=frozenset(words) - family, stems=frozenset(stems), family=family)
    spoken = counted.filter("kind = 'w' and o > t")
    model.benign = frozenset(r.term for r in spoken.mapInArrow(_neighbours(model), "term string").collect())
    rows = np.array([tuple(r) for r in train.mapInArrow(_features(model), "a double, b double, c double, d double, y int").collect()])
    x, y = rows[:, :4], rows[:, 4]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    design = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(5)
    ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2, 1e-2]) * len(x) * 0.01
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.mean, model.scale, model.weights, model.fitted, model.trie = tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), True, None
    return model


def _neighbours(model: Model):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            terms = [w for w in batch.column(1).to_pylist() if w not in model.words]
            weights = scorer.weigh(terms)
            out = [w for w in terms if 0 < weights.get(w, 0) < 1]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["term"])

    return near


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = list(scorer.all_features([t or "" for t in batch.column(0).to_pylist()]))
            columns = list(zip(*x, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.float64()) for c in columns], batch.column(1)], ["a", "b", "c", "d", "y"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            keep = [x < CUT for x in scorer.scores(batch.column(place).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the model is fitted on labelled rows that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(training_rows(docs, labels))).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
