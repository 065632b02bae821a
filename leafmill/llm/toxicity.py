"""Toxicity by weak supervision.

Many voters look at a text: a fixed lexicon, lexicons of word beginnings
induced from labelled rows, and patterns of spelling. A generative label model
estimates by expectation-maximisation how often each voter is right in each
class and how strongly voters agree beyond what the class explains; correlated
voters share their weight. Its posterior labels train a linear classifier over
words and word beginnings, whose score is what comes out. Human labels of
learning rows choose the induced lexicons, set the prior of the label model, and
place the cut of the classifier over scores from folds that have not seen the
row; they are no voter, and no target of the classifier.

Only labelled rows with ``crc32(doc_id as text) % 5 <> 0`` are learned from, at
most ``max_labelled`` of them, taken in the order of a hash of doc_id (the bound
is for fitting alone: every document is scored, over its whole text). Label,
language, source and doc_id are no inputs of a score.

Defined results: a null or empty text is scored by the classifier's intercept.
Rows with a null doc_id are scored and never learned from; of several labels of
one doc_id the larger counts. Without labelled rows of both classes the fixed
lexicon alone decides. Repeated rows are scored alike; extra columns are kept
by ``reject_toxic`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, text_batches

#: Insults and threats that the lexicon voter knows.
LEXICON = """
bastard clown coward creep degenerate disgusting dumb dumbass fool freak garbage idiot imbecile jerk
loser lowlife moron pathetic pig retard scum scumbag shameless sick stupid trash ugly vermin vile worthless
""".split()

MAX_LABELLED = 12_000
#: Rows that a feature needs, and its deviation from chance; the number of features has no other bound than the labelled rows.
MIN_ROWS, MIN_Z = 4, 2.0
#: Deviation and share of toxic rows from which a feature is a voter's.
STRONG_Z, STRONG_SHARE = 4.0, 0.9
FOLDS = 2
INDUCED_VOTERS = 16
BEGINNINGS = (4, 5, 6, 7, 8)
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 5) = 0"

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
_BANG = re.compile(r"[!?]{2,}")


def features_of(text: str | None) -> set[str]:
    """Whole words and word beginnings of a text; ``w:`` marks a whole word, a number its beginning."""
    found = set()
    for w in set(_WORD.findall((text or "").lower())):
        found.add("w:" + w)
        for k in BEGINNINGS:
            if len(w) >= k:
                found.add(w[:k])
    return found


@dataclass
class Model:
    """What scoring needs: features with weights, and the intercept; ``agreement`` is the share of learning rows whose posterior tells their label."""

    weights: dict[str, float] = field(default_factory=dict)
    hit_weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    intercept: float = -2.0
    strong: frozenset[str] = frozenset()
    accuracies: list[tuple[str, float]] = field(default_factory=list)
    agreement: float = 0.0

    def score(self, text: str | None) -> float:
        present = 0.0
        hits = set()
        get = self.weights.get
        for w in set(_WORD.findall((text or "").lower())):
            present += get("w:" + w, 0.0)
            for k in BEGINNINGS:
                if len(w) >= k:
                    b = w[:k]
                    present += get(b, 0.0)
                    if b in self.strong:
                        hits.add(w)
            if "w:" + w in self.strong:
                hits.add(w)
        n = min(len(hits), 2)
        z = self.intercept + present + self.hit_weights[n]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def votes_of(text: str | None, present: set[str], strong: dict[str, int]) -> list[int]:
    """One vote per voter: 1 toxic, -1 clean, 0 abstains."""
    text = text or ""
    lexicon = sum("w:" + w in present for w in LEXICON)
    groups = [0] * INDUCED_VOTERS
    hits = set()
    for f in present:
        g = strong.get(f)
        if g is not None:
            groups[g] = 1
            hits.add(f.removeprefix("w:")[: BEGINNINGS[0]])
    words = max(1, len(text) // 6)
    return [
        *groups,
        1 if lexicon else 0,
        1 if lexicon > 1 else 0,
        1 if len(hits) > 1 else 0,
        -1 if not hits and not lexicon else 0,
        -1 if not hits and words > 20 else 0,
        1 if len(_SHOUT.findall(text)) * 20 > words else 0,
        1 if len(_BANG.findall(text)) * 20 > words else 0,
    ]


def label_model(votes: np.ndarray, prior: float, rounds: int = 50, settle: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, weight of each voter, log odds of each voter and vote) by EM.

    ``votes``: rows x voters of -1, 0, 1. The model gives each voter a chance of
    each vote in each class. Correlations: the voters' residual products, given
    the posterior, become excess agreement; a voter's log odds are divided by
    one plus its agreement with the others. The first ``settle`` rounds take the
    voters as independent, because residuals mean nothing while the posterior is
    still undecided.
    """
    n, m = votes.shape
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    post = np.clip(prior + 0.35 * np.sign(votes.sum(1)), 0.02, 0.98)
    weight = np.ones(m)
    odds = np.zeros((m, 3))
    for turn in range(rounds):
        p1 = (np.einsum("n,nmv->mv", post, onehot) + 0.5) / (post.sum() + 1.5)
        p0 = (np.einsum("n,nmv->mv", 1 - post, onehot) + 0.5) / ((1 - post).sum() + 1.5)
        odds = np.log(p1) - np.log(p0)
        mean = post[:, None] * (p1[:, 2] - p1[:, 0]) + (1 - post)[:, None] * (p0[:, 2] - p0[:, 0])
        left = votes - mean
        scale = np.sqrt((left**2).mean(0)) + 1e-6
        corr = np.abs(left.T @ left / n / scale[:, None] / scale[None, :])
        np.fill_diagonal(corr, 0)
        if turn >= settle:
            weight = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))
        z = np.log(prior / (1 - prior)) + np.einsum("nmv,mv,m->n", onehot, odds, weight)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if turn > settle and np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = new
    return post, weight, odds


def fit_linear(rows: list[np.ndarray], hits: np.ndarray, target: np.ndarray, n_features: int, rounds: int = 300, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft targets over sparse rows and three hit classes, by Adam."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    hot = np.eye(3)[hits]
    p = np.zeros(n_features + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    rate = 0.08
    for t in range(1, rounds + 1):
        z = np.bincount(at, p[col], len(rows)) + hot @ p[n_features : n_features + 3] + p[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.r_[np.bincount(col, err[at], n_features), hot.T @ err, err.sum()]
        g[:-4] += l2 * p[:-4]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:n_features], p[n_features : n_features + 3], float(p[-1])


def out_of_fold(rows: list[np.ndarray], hits: np.ndarray, target: np.ndarray, n_features: int) -> np.ndarray:
    """Log odds of every row from a classifier that was fitted on the rows of the other folds."""
    z = np.zeros(len(rows))
    fold = np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        w, h, b = fit_linear([r for r, f in zip(rows, fold, strict=True) if f != k], hits[fold != k], target[fold != k], n_features)
        for i in np.flatnonzero(fold == k):
            z[i] = w[rows[i]].sum() + h[hits[i]] + b
    return z


def best_cut(z: np.ndarray, label: np.ndarray) -> float:
    """The log odds at which most labels are told right: the middle of the widest such stretch."""
    order = np.argsort(z)
    z, label = z[order], label[order]
    right = np.r_[0, np.cumsum(np.where(label == 0, 1, -1))]  # rows below the cut are called 0
    edges = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
    wide = np.r_[1.0, np.diff(z), 1.0]
    best = np.flatnonzero(right == right.max())
    return float(edges[best[wide[best].argmax()]])


def voter_of(feature: str) -> int:
    """Beginnings of one stem share a voter, so that its votes aren't counted again."""
    stem = feature.removeprefix("w:")[: BEGINNINGS[0]]
    return hashlib.md5(stem.encode()).digest()[0] % INDUCED_VOTERS


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits voters, label model and classifier on a bounded sample of labelled rows."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(f"not ({HELD_OUT})").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    marks = F.broadcast(marks)  # at most max_labelled rows
    known = docs.select("doc_id", "text").join(marks, "doc_id")  # other columns of docs may have the marks' names
    known = cut(text_batches(known.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                (pos if toxic else neg).update(features_of(text))
        names = list(pos.keys() | neg.keys())
        yield pd.DataFrame({"f": names, "pos": [pos[x] for x in names], "neg": [neg[x] for x in names]})

    total = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, n_pos = total[0], total[1] or 0
    if not n_pos or n_pos == n:
        lexicon = {"w:" + w: 4.0 for w in LEXICON}
        return Model(lexicon, (0.0, 0.0, 0.0), -2.0, frozenset(lexicon))
    seen = known.mapInPandas(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    seen = seen.where(F.col("pos") + F.col("neg") >= MIN_ROWS)
    rate = n_pos / n
    both = F.col("pos") + F.col("neg")
    # deviation of the toxic count from what chance would give; rare features of one class alone rank as they should
    z = (F.col("pos") - rate * both) / F.sqrt(rate * (1 - rate) * both)
    ranked = cut(seen.select("f", "pos", "neg", z.alias("z"), F.substring(F.regexp_replace("f", "^w:", ""), 1, BEGINNINGS[0]).alias("stem")))
    top = ranked.where(F.col("z") >= MIN_Z).orderBy(F.col("z").desc(), "f").collect()  # words of at most max_labelled texts
    # clean words that begin like toxic ones are what else the classifier has to know
    stems = sorted({r.stem for r in top if r.z > STRONG_Z and r.pos > STRONG_SHARE * (r.pos + r.neg)})
    top += ranked.where((F.col("z") <= 0) & F.col("stem").isin(stems)).orderBy("z", "f").collect() if stems else []
    index = {r.f: i for i, r in enumerate(top)}
    # a beginning that nearly always goes on in one way says no more than its longer form, and less surely
    longer: Counter[str] = Counter()
    for r in top:
        name = r.f.removeprefix("w:")
        for k in BEGINNINGS:
            if k < len(name) or (k == len(name) and r.f != name):
                longer[name[:k]] = max(longer[name[:k]], r.pos)
    strong = {r.f: voter_of(r.f) for r in top if r.z > STRONG_Z and r.pos / (r.pos + r.neg + 0.5) > max(STRONG_SHARE, rate) and (r.f.startswith("w:") or longer[r.f] < 0.95 * r.pos)}

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                present = features_of(text)
                words = {w for w in set(_WORD.findall((text or "").lower())) if "w:" + w in strong or any(w[:k] in strong for k in BEGINNINGS if len(w) >= k)}
                out.append((votes_of(text, present, strong), sorted(index[x] for x in present & index.keys()), min(len(words), 2), toxic))
            yield pd.DataFrame(out, columns=["votes", "cols", "hits", "toxic"])

    rows = known.mapInPandas(vote, "votes array<int>, cols array<int>, hits int, toxic int").collect()  # bounded by max_labelled
    label = np.array([r.toxic for r in rows])
    post, weight, table = label_model(np.array([r.votes for r in rows]).astype(float), float(np.clip(rate, 0.01, 0.9)))
    hits = np.array([r.hits for r in rows])
    cols = [np.array(r.cols, np.int64) for r in rows]
    w, h, b = fit_linear(cols, hits, post, len(top))
    b -= best_cut(out_of_fold(cols, hits, post, len(top)), label)
    names = [f"induced{i}" for i in range(INDUCED_VOTERS)] + ["lexicon", "lexicon2", "hits2", "none", "none_long", "shout", "bang"]
    weights = {r.f: float(x) for r, x in zip(top, w, strict=True)}
    voters = list(zip(names, (table[:, 2] * weight).tolist(), strict=True))
    return Model(weights, tuple(map(float, h)), b, frozenset(strong), voters, float(((post > 0.5) == label).mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, and score: 0 to 1, higher where label 1 is likelier."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    text_batches(docs)
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), scored(docs["text"]).alias("score"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; same columns."""
    out = score(docs, fit(docs, labels)).where(F.col("score") < threshold)
    return out.select("row.*")
