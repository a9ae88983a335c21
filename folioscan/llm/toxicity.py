"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and scores of the context.

Fitting takes at most SAMPLE labelled documents. A word enters the lexicon when the log-likelihood ratio of the documents
that hold it, toxic against clean, stands out among as many words as were counted; a stem enters when that holds of its
prefix and no single word accounts for it. The automaton that accepts all terms with their allowed misspellings is the
intersection of the trie with the Levenshtein automata, determinised as it is walked. Words near a term that clean
documents hold are no misspellings, unless toxic ones mostly do. A term that clean documents also hold now and then is
weak, and so are its misspellings, with a weight of their own. A hit in quotation marks or after a word of report is a
quotation, unless others stand close by; a logistic model over the kinds of hits, fitted to a table of counts, gives the
score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan.llm.common import materialise, table, texts_of

#: Most labelled documents that are fitted on: those of the smallest hashes of their ids.
SAMPLE = 10_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Chance that any word enters by accident; least share of toxic documents among those that hold a weak, a strong term.
ALPHA, PURITY, STRONG = 0.2, 0.4, 0.97
WINDOW, REPORT_WINDOW = 8, 4
#: Tokens, and states of the automaton, that a worker remembers.
MEMO, STATES = 100_000, 500_000
#: Words of report, fixed.
REPORT = frozenset("said says say quote quoted quotes called calls word term wrote reported zitat zitiert sagte nannte wort dit cite mot dijo cita palabra llamó".split())
QUOTES = "\"“”„«»‘’‹›"
NO_HITS = (0, 0, 0, 0, 0, 0)
#: What is taken to have been seen before any documents: features, toxic, clean. They tell of kinds of hits that the labels don't show.
BEFOREHAND = [((1, 0, 0, 0, 0, 0), 4.0, 0.2), ((0, 0, 1, 0, 0, 0), 0.3, 2.0), ((0, 0, 0, 1, 0, 0), 2.0, 0.4), ((0, 0, 0, 0, 1, 0), 0.5, 0.5), ((0, 0, 0, 0, 0, 1), 0.5, 0.5), (NO_HITS, 0.1, 1.0)]
RIDGE = 0.02

_TOKEN = re.compile(r"[^\W_]+")


@dataclass
class Lexicon:
    """Terms as {text: is a stem}; those in `weak` are evidence of their own kind; tokens in `benign` are no misspellings.
    Holds the automaton as far as it has been walked."""

    terms: dict[str, bool]
    weak: frozenset[str] = frozenset()
    benign: frozenset[str] = frozenset()
    children: list[dict[str, int]] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.children, self._ends = [{}], {}
        for term in sorted(self.terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self._ends[node] = (term, self.edits(term))
        self._most = [self._ends[i][1] if i in self._ends else 0 for i in range(len(self.children))]  # edits that any term below a node allows
        for node in reversed(range(len(self.children))):  # children come after their parents
            self._most[node] = max([self._most[node], *(self._most[x] for x in self.children[node].values())])
        self._step: dict[tuple[frozenset, str], frozenset] = {}
        self._sets: dict[frozenset, frozenset] = {}  # one object for each set, however many steps lead to it
        self._states = 0  # in these sets, and one for each step
        self._same: dict[tuple[int, int], tuple[int, int]] = {}  # one object for each state, however many sets it is in
        self._start = self._closed({0: 0})
        self._memo: dict[str, tuple[str, int] | None] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weak": self.weak, "benign": self.benign}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def edits(self, term: str) -> int:
        """Edits that a term allows; a stem needs more letters for them."""
        n = len(term)
        return int(n >= 7) if self.terms[term] else int(n >= 5) + int(n >= 9)

    def _closed(self, states: dict[int, int]) -> frozenset:
        """With the states that are reached by leaving out letters of terms. A state is (node, edits so far), no more edits than a term below the node allows."""
        todo, most = list(states.items()), self._most
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values() if e < most[node] else ():
                if e < most[child] and states.get(child, 3) > e + 1:
                    states[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(self._same.setdefault(x, x) for x in states.items())

    def _next(self, at: frozenset, c: str) -> frozenset:
        if (at, c) not in self._step:
            states: dict[int, int] = {}
            most = self._most
            for node, e in at:
                end = self._ends.get(node)
                if end and self.terms[end[0]] and e <= end[1]:
                    states[node] = min(e, states.get(node, 3))  # a stem takes any ending
                child = self.children[node].get(c)
                if child is not None and e <= most[child]:
                    states[child] = min(e, states.get(child, 3))
                if e < most[node]:
                    states[node] = min(e + 1, states.get(node, 3))
                    for other in self.children[node].values():
                        if e < most[other]:
                            states[other] = min(e + 1, states.get(other, 3))
            if self._states > STATES:
                self._step.clear()
                self._sets.clear()
                self._states = 0
            new = self._closed(states)
            self._states += len(new) if new not in self._sets else 1
            self._step[at, c] = self._sets.setdefault(new, new)
        return self._step[at, c]

    def match(self, token: str) -> tuple[str, int] | None:
        """The term that a token is, in any spelling that the term allows, and the edits; a strong term if there is one."""
        at = self._start
        for c in token:
            at = self._next(at, c)
            if not at:
                return None
        found = [(e, term in self.weak, term) for node, e in at if node in self._ends for term, most in [self._ends[node]] if e <= most]
        if not found or min(found)[0] and token in self.benign:
            return None
        e, _, term = min(found)
        return term, e

    def lookup(self, token: str) -> tuple[str, int] | None:
        if token not in self._memo:
            if len(self._memo) > MEMO:
                self._memo.clear()
            if len(token) > 64:
                return self.match(token)
            self._memo[token] = self.match(token)
        return self._memo[token]

    def features(self, text: str | None) -> tuple[int, int, int, int, int, int]:
        """(any term, further terms, any quoted term, any misspelled term, weak hits, misspelled weak ones) of a text."""
        low = (text or "").lower()
        tokens = _TOKEN.findall(low)
        known, lookup = self._memo, self.lookup
        hits = [i for i, t in enumerate(tokens) if (known[t] if t in known else lookup(t))]
        if not hits:
            return NO_HITS
        spans = [m.span() for m in _TOKEN.finditer(low)]
        plain, quoted, misspelled, weak, unsure = 0, 0, 0, 0, 0
        for i in hits:
            left, right = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
            before, after = low[spans[left][0] : spans[i][0]], low[spans[i][1] : spans[right - 1][1] + 1]
            cited = any(c in before for c in QUOTES) and any(c in after for c in QUOTES) or any(t in REPORT for t in tokens[max(0, i - REPORT_WINDOW) : i])
            near = sum(left <= j < right for j in hits) - 1
            if 1 - cited + 0.25 * near < 0.5:
                quoted += 1
            elif lookup(tokens[i])[0] in self.weak:
                weak += not lookup(tokens[i])[1]
                unsure += lookup(tokens[i])[1] > 0
            elif lookup(tokens[i])[1]:
                misspelled += 1
            else:
                plain += 1
        return int(plain > 0), max(0, plain - 1), int(quoted > 0), int(misspelled > 0), weak, unsure


def evidence(features: tuple[int, ...]) -> list[float]:
    """What the model takes of the features: every further hit tells less than the one before."""
    return [float(np.log2(1 + f)) for f in features]


def fit_weights(counts: list[tuple[tuple[int, ...], float, float]]) -> np.ndarray:
    """Weights and, last, the bias of the logistic model of (features, toxic, clean) and BEFOREHAND, by Newton's method."""
    seen = [*counts, *BEFOREHAND]
    x = np.array([[*evidence(f), 1] for f, _, _ in seen], dtype=float)
    y, n = np.array([p for _, p, _ in seen], dtype=float), np.array([p + q for _, p, q in seen], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - n * p) - RIDGE * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.weights, [*evidence(self.lexicon.features(text)), 1]))))


def _mapped(df: DataFrame, lexicon: Lexicon, text_col: str, schema: str, to) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(lexicon)  # words and stems of SAMPLE documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield to(sent.value, b)

    return df.mapInPandas(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learns from labelled rows outside the held-out fifth, at most `sample` of them, copies of a text counting once. What
    stands out among these documents' words and stems is the lexicon, without a further bound.

    Rows without label, id or text teach nothing; of several labels of one id, the greatest holds. Without any labelled
    rows the lexicon is empty and every score is that of BEFOREHAND."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    known = materialise(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "toxic-sample")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(known), F.col("_doc") == F.col("_id"))  # at most `sample` rows
    rows = materialise(rows.groupBy(F.lower("_text").alias("text")).agg(F.max("_toxic").alias("toxic")), "toxic-texts")
    split = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    t, u = split.get(1, 0), split.get(0, 0)
    if not t or not u:
        return ToxicityModel(Lexicon({}), fit_weights([(NO_HITS, t, u)] if t + u else []))
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("word"))
    words = words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    words = materialise(words, "toxic-words")
    per_doc = rows.select("toxic", F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]{5,})"), 1)).alias("w"))
    per_doc = per_doc.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform("w", lambda w: F.transform(F.filter(F.array(*map(F.lit, STEM_LENGTHS)), lambda n: n < F.length(w)), lambda n: w.substr(F.lit(1), n)))))).alias("stem"))
    stems = per_doc.groupBy("stem").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))

    def g2(pos: Column, neg: Column) -> Column:
        n, k = float(t + u), pos + neg
        part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        return 2 * (part(pos, k * t / n) + part(neg, k * u / n) + part(t - pos, (n - k) * t / n) + part(u - neg, (n - k) * u / n))

    def stands_out(stats: DataFrame) -> DataFrame:
        bar = float(2 * np.log(max(2, stats.count()) / ALPHA))
        return stats.where((F.col("pos") * u > F.col("neg") * t) & (F.col("pos") / (F.col("pos") + F.col("neg")) >= PURITY) & (g2(F.col("pos"), F.col("neg")) >= bar))

    pure = lambda r: r["pos"] >= STRONG * (r["pos"] + r["neg"] + 1)  # noqa: E731  not on few documents
    found = {r["word"]: r for r in stands_out(words).collect()}
    stem_rows = sorted(((len(r["stem"]), r["stem"], r) for r in stands_out(materialise(stems, "toxic-stems")).collect()), key=lambda x: x[:2])
    most = {s: 0 for _, s, _ in stem_rows}
    if most:
        tops = words.where("pos > 0").select("pos", F.explode(F.transform(F.filter(F.array(*map(F.lit, STEM_LENGTHS)), lambda n: n <= F.length("word")), lambda n: F.col("word").substr(F.lit(1), n))).alias("stem"))
        most |= {r["stem"]: r["top"] for r in tops.where(F.col("stem").isin(list(most))).groupBy("stem").agg(F.max("pos").alias("top")).collect()}
    terms: dict[str, bool] = {}
    weak: set[str] = set()
    covered = lambda x: any(terms.get(x[:n]) and x[:n] not in weak for n in STEM_LENGTHS if n < len(x))
    for _, stem, r in stem_rows:
        if r["pos"] >= 1.5 * most[stem] and not covered(stem):
            terms[stem] = True
            weak |= set() if pure(r) else {stem}
    for word, r in sorted(found.items()):
        if not covered(word) and word not in terms:
            terms[word] = False
            weak |= set() if pure(r) else {word}
    # a misspelling that clean documents quote stays one if the documents that hold it are as toxic as those of a term must be, and one more clean
    near = _mapped(words.where((F.col("neg") > 0) & (F.col("pos") < PURITY * (F.col("pos") + F.col("neg") + 1))), Lexicon(terms, frozenset(weak)), "word", "word string, neg long", lambda lex, b: b.loc[[bool((m := lex.match(w)) and m[1]) for w in b["word"]], ["word", "neg"]])
    near = {r["word"]: r["neg"] for r in near.collect()}  # at most the words of the sample
    lexicon = Lexicon(terms, frozenset(weak), benign=frozenset(near))
    # weights are fitted as if a word that one clean document holds were new there, as words of other documents are
    fitted = Lexicon(terms, frozenset(weak), benign=frozenset(w for w, n in near.items() if n > 1))
    names = ("f0", "f1", "f2", "f3", "f4", "f5")
    seen = _mapped(rows, fitted, "text", "f0 int, f1 int, f2 int, f3 int, f4 int, f5 int, toxic int", lambda lex, b: pd.DataFrame(list(map(lex.features, b["text"])), columns=list(names)).assign(toxic=b["toxic"].to_numpy()))
    counts = [(tuple(r[:6]), r["p"], r["q"]) for r in seen.groupBy(*names).agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).collect()]  # no more than the sample
    return ToxicityModel(lexicon, fit_weights(counts))


def _scorer(docs: DataFrame, model: ToxicityModel):
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its lexicon is of the sample's words and stems

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score_of = sent.value.score
        for b in batches:
            yield pa.array([score_of(t) for texts in texts_of(b) for t in texts], pa.float64())

    return score


def with_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the probability that each text is toxic. Null and empty texts have the score of a text without hits; all
    rows, repeated ones too, and all columns stay, but for one of the name out_col. An empty table stays empty."""
    return docs.withColumn(out_col, _scorer(docs, model)(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that a model fitted to them and the labels holds clean, with all their columns, which may have any names."""
    return docs.where(_scorer(docs, fit(docs, labels, text_col=text_col, **how))(docs[text_col]) < 0.5)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
