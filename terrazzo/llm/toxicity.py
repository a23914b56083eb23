"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string over a few classes: insult, threat, target,
negation, reported speech, anything else. One small transducer per class keeps
what is in force at each word (a negation reaches a few words ahead, reported
speech to the end of the clause, a target a few words either way); their
product is compiled once and emits weighted events, each an insult or threat
with the conditions it occurs under. Event sums over a text's clauses, not
isolated words, are what the score is made of.

Insult terms, words and word beginnings, and the weights of the events are
learned from labelled rows. Learning reads at most ``MAX_ROWS`` rows, chosen by
a hash of their id inside each label, and keeps at most ``MAX_TERMS`` terms, so
what the driver holds does not grow with the corpus. A label rarer than
``LEAST`` of the rows has so many all the same, and each row then counts as
often as it stands for others.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.storage import discard, materialize

MAX_ROWS = 20_000
MAX_TERMS = 2_000
#: Share of the sample kept for a rare label.
LEAST = 0.1
#: A term is kept if it occurs in so many toxic texts, which are such a share of all it occurs in,
#: and if that is too unlikely by chance among all terms tried, by a factor of e to the power SURE.
MIN_TEXTS, MIN_SHARE, SURE = 4, 0.9, 1.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3

# Closed classes of the grammar, by language.
TARGETS = """you your yourself he she him her they them his their this that tu te toi vous il elle eux du dich dir ihr
sie er ihn usted ustedes ellos ellas el""".split()
NEGATIONS = "not no never without isn't aren't wasn't don't doesn't pas jamais non sans nicht kein keine nie ohne nunca sin".split()
REPORTS = """said says say saying told tells reported reports claimed claims wrote writes quoted quote alleged called
according dit disait selon sagt sagte laut dijo dice""".split()
THREATS = "kill hurt destroy burn beat stab shoot hang bomb attack punish tuer détruire töten vernichten matar destruir".split()

CLASSES = "itpnro"
_CLOSED = {**dict.fromkeys(THREATS, "t"), **dict.fromkeys(TARGETS, "p"), **dict.fromkeys(NEGATIONS, "n"), **dict.fromkeys(REPORTS, "r")}
#: Words that a negation, a target and a threat reach.
REACH = {"n": 3, "p": 4, "t": 4}
EVENTS = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_negated", "threat_reported")

_CLAUSES = re.compile(r"[^.!?;\n]+")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def _countdown(symbol: str):
    """Transducer that remembers for some words that ``symbol`` was read."""
    reach = REACH[symbol]
    return range(reach + 1), lambda state, s: reach if s == symbol else max(0, state - 1)


def _latch(symbol: str):
    return range(2), lambda state, s: 1 if s == symbol else state


def compose() -> dict[tuple[int, str], tuple[int, tuple[str, ...]]]:
    """Product of the class transducers: (state, class) to (state, events)."""
    parts = {"n": _countdown("n"), "p": _countdown("p"), "t": _countdown("t"), "r": _latch("r")}
    names = list(parts)
    states = {s: k for k, s in enumerate(product(*(parts[n][0] for n in names)))}
    table = {}
    for s, k in states.items():
        now = dict(zip(names, s))
        for c in CLASSES:
            out = []
            under = "_reported" if now["r"] else "_negated" if now["n"] else ""
            if c == "i":
                out.append("insult" + (under or ("_targeted" if now["p"] else "")))
            if c == "p" and now["t"]:
                out.append("threat" + under)
            table[k, c] = (states[tuple(parts[n][1](now[n], c) for n in names)], tuple(out))
    return table


GRAMMAR = compose()


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(EVENTS))
    bias: float = 0.0

    def __post_init__(self):
        self.first = {t.rstrip("*")[: BEGINNINGS[0]] for t in self.terms} | {t[: BEGINNINGS[0]] for t in THREATS}

    def insult(self, word: str) -> float:
        """Weight of a word: the best of its own and its beginnings'."""
        terms = self.terms
        return max(terms.get(word, 0.0), *(terms.get(word[:k] + "*", 0.0) for k in BEGINNINGS if len(word) >= k), 0.0)

    def events(self, text: str) -> np.ndarray:
        """Weighted event sums over the clauses of a text."""
        out = np.zeros(len(EVENTS))
        low = text.lower()
        first, size = self.first, BEGINNINGS[0]
        if not any(w[:size] in first for w in _WORDS.findall(low)):
            return out
        at = {e: k for k, e in enumerate(EVENTS)}
        for clause in _CLAUSES.findall(low):
            words = _WORDS.findall(clause)
            if not any(w[:size] in first for w in words):
                continue
            state = 0
            for w in words:
                weight = self.insult(w) if w[:size] in first else 0.0
                state, found = GRAMMAR[state, "i" if weight else _CLOSED.get(w, "o")]
                for e in found:
                    out[at[e]] += weight or 1.0
        return out

    def score(self, text: str | None) -> float:
        x = self.bias + float(np.log1p(self.events(text or "")) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(text: str) -> set[str]:
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k}


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """``(text, toxic)`` of at most ``MAX_ROWS`` learnable labelled rows, and how much a clean and a toxic one count."""
    order = F.xxhash64(F.lit(5), "doc_id")
    rows = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = [0, 0]
    for r in rows.groupBy((F.col("toxic") > 0).alias("bad")).count().collect():
        n[r.bad] = r["count"]
    take, least = list(n), int(MAX_ROWS * LEAST)
    if sum(n) > MAX_ROWS:
        take[1] = min(n[1], max(round(MAX_ROWS * n[1] / sum(n)), least), MAX_ROWS - min(n[0], least))
        take[0] = MAX_ROWS - take[1]
    clean, bad = (rows.where(c).orderBy(order, "doc_id", "toxic").limit(k) for c, k in zip(("toxic <= 0", "toxic > 0"), take))
    counts = tuple(a / b * sum(take) / sum(n) if b else 1.0 for a, b in zip(n, take))
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(clean.unionByName(bad)), "doc_id").select("text", "toxic"), counts


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches):
        total, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                found = _features(text)
                total.update(found)
                if label:
                    toxic.update(found)
        terms = list(total)
        for a in range(0, len(terms), 50_000):
            part = terms[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[t] for t in part], pa.int64()), pa.array([toxic[t] for t in part], pa.int64())], ["term", "total", "toxic"])

    parts = rows.mapInArrow(run, "term string, total long, toxic long")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn terms and event weights from ``docs`` that ``labels`` marks, joined by ``doc_id``.

    Null ids, labels and texts teach nothing; rows repeated in either table
    count as often as they are there, up to the sample's bound. Other columns
    are not read. Without labelled rows of both kinds nothing tells them apart: the model
    scores the smoothed share of toxic rows, below ``THRESHOLD``, for every
    text, so that none is rejected.
    """
    rows, (clean, bad) = sample(docs, labels)
    # At most MAX_ROWS texts, which are read three times.
    rows, path = materialize(rows, "sample")
    heavy = F.col("toxic") * bad
    share = heavy / (heavy + (F.col("total") - F.col("toxic")) * clean)
    weight = F.when(F.col("toxic") > 0, bad).otherwise(clean)
    base = rows.agg(F.sum(F.col("toxic") * weight) / F.sum(weight)).first()[0] or 1.0
    tried, _ = materialize(_counts(rows).where(F.col("toxic") >= MIN_TEXTS), "terms")
    bound = np.log(max(1, tried.count())) + SURE
    gain = F.col("toxic") * F.log(share / F.lit(float(base)))
    kept = tried.withColumn("share", share).where((share >= MIN_SHARE) & (gain >= float(bound))).orderBy(F.desc(gain), "term").limit(MAX_TERMS).collect()
    terms = {r.term: float(r.share) for r in kept}
    model = Model(terms)

    def run(batches):
        for batch in batches:
            x = np.array([model.events(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(EVENTS))
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1)], [*EVENTS, "toxic"])

    schema = ", ".join(f"{e} double" for e in EVENTS) + ", toxic int"
    # Distinct event rows are few: counts of words under conditions.
    seen = rows.mapInArrow(run, schema).groupBy(*EVENTS, "toxic").count().orderBy(F.desc("count"), *EVENTS, "toxic").limit(MAX_ROWS).collect()
    discard(docs.sparkSession, path)
    if not seen or len({r.toxic for r in seen}) < 2:
        n, toxic = sum(r["count"] for r in seen), sum(r["count"] for r in seen if r.toxic > 0)
        prior = min((toxic + 1) / (n + 20), THRESHOLD / 2)
        model.bias = float(np.log(prior / (1 - prior)))
        return model
    x = np.log1p(np.array([r[: len(EVENTS)] for r in seen], float))
    y = np.array([float(r.toxic > 0) for r in seen])
    model.weights, model.bias = logistic(x, y, np.array([r["count"] * (bad if r.toxic > 0 else clean) for r in seen], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[list[float], float]:
    """Weights and bias by ridge-penalised Newton steps; rows count ``n`` times.

    The penalty pulls every event towards the mean of all, so that one that
    was hardly seen counts like the others rather than not at all.
    """
    common = np.c_[x.sum(1), np.ones(len(x))]
    theta = _newton(common, y, n, np.zeros(2), np.array([0.0, 0.0]) + 1e-3, rounds)
    prior = np.append(np.full(x.shape[1], theta[0]), theta[1])
    theta = _newton(np.c_[x, np.ones(len(x))], y, n, prior, np.append(np.full(x.shape[1], ridge), 1e-3), rounds)
    return theta[:-1].tolist(), float(theta[-1])


def _newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: np.ndarray, rounds: int) -> np.ndarray:
    theta = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (p - y)) + ridge * (theta - prior))
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return theta


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, one row per input row; null texts score like empty ones.

    Only the text counts. A null doc_id stays null, repeated rows give
    repeated results, empty tables give empty results.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without rows that score at or above ``threshold``.

    Only the text decides: null and blank texts stay, as their score is that of
    a text without events; equal texts share their fate, whatever their ids;
    an empty table stays empty.
    """

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype=float)

    return docs.where(scored("text") < threshold)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
