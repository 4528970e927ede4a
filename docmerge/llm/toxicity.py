"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is logistic in its words and their beginnings; a document's score is the noisy-or of its sentences. Only
document labels are needed to train, by gradient steps on the likelihood of the noisy-or; sentence scores then
locate what offends. The model is fitted in one task on at most ``bound`` rows: labelled documents chosen by a hash of their ids, and of
an id with several texts the one of the smallest hash; scoring is one pass over all texts.

Nulls: a null text is empty and scores 0; null labels and null ids are not learned from. Repeated documents are scored one by one; an
id with several labels counts as toxic if one of them says so. An empty table gives no rows; without any label of
both kinds every score is 0. Columns other than the named ones are ignored. Sentences of any number and length count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmerge.llm.common import id_number, id_text

#: Labelled documents to fit on, and features of the model, at most.
BOUND, FEATURES = 8000, 20_000
#: Word beginnings of these lengths are features too.
PREFIXES = (4, 5, 6)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")
BIAS = "bias"


def _features(word: str) -> Iterator[str]:
    yield word
    for length in PREFIXES:
        if len(word) > length:
            yield f"{word[:length]}*"


def _sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    for match in _SENTENCE.finditer(text):
        yield *match.span(), set(_WORD.findall(match.group().lower()))


def train(texts: list[str], labels: np.ndarray, steps: int = 400, least: int = 3, rate: float = 0.1, shrink: float = 2e-4) -> dict[str, float]:
    """Feature weights. Features that no toxic document favours are left out: they cannot make a sentence toxic."""
    toxic = int(labels.sum())
    if toxic in (0, len(labels)):
        return {BIAS: -30.0}
    # Features are counted in the toxic documents first: only those seen there can be chosen, and others are not held.
    bad = Counter()
    for text, label in zip(texts, labels):
        if label:
            bad.update({f for *_, words in _sentences(text) for w in words for f in _features(w)})
    bad = {f: n for f, n in bad.items() if n >= least}
    fine = dict.fromkeys(bad, 0)
    for text, label in zip(texts, labels):
        if not label:
            for f in {f for *_, words in _sentences(text) for w in words for f in _features(w) if f in fine}:
                fine[f] += 1
    odds = {f: (n + 0.1) / (toxic + 0.2) / ((fine[f] + 0.1) / (len(labels) - toxic + 0.2)) for f, n in bad.items()}
    chosen = sorted((f for f, x in odds.items() if x > 2), key=lambda f: (-bad[f] * math.log(odds[f]), f))[:FEATURES]
    number = {f: i for i, f in enumerate(chosen)}
    rows, columns, owner = [], [], []
    plain = np.zeros(len(texts))  # sentences without any feature
    for document, text in enumerate(texts):
        for *_, words in _sentences(text):
            found = sorted({number[f] for w in words for f in _features(w) if f in number})
            if found:
                rows += [len(owner)] * len(found)
                columns += found
                owner.append(document)
            else:
                plain[document] += 1
    rows, columns, owner = (np.array(x, dtype=np.int64) for x in (rows, columns, owner))
    weights, bias = np.zeros(len(chosen)), -5.0
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        logits = bias + np.bincount(rows, weights[columns], len(owner))
        doubt = np.bincount(owner, np.logaddexp(0, logits), len(texts)) + plain * np.logaddexp(0, bias)
        pull = np.where(labels == 1, -1 / np.expm1(np.maximum(doubt, 1e-9)), 1.0) / len(texts)
        sentence = pull[owner] / (1 + np.exp(-logits))
        slope = np.append(np.bincount(columns, sentence[rows], len(chosen)) + shrink * weights / len(texts) ** 0.5, sentence.sum() + (pull * plain).sum() / (1 + np.exp(-bias)))
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return {BIAS: float(bias)} | {f: float(w) for f, w in zip(chosen, weights)}


class Scorer:
    """Scores texts; the weights of words already met are kept, up to a number."""

    def __init__(self, weights: dict[str, float], keep: int = 200_000):
        self.weights, self.bias, self.keep = weights, weights[BIAS], keep
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = sum(self.weights.get(f, 0.0) for f in _features(word))
        if len(self.words) >= self.keep:
            self.words.clear()
        self.words[word] = value
        return value

    def score(self, text: str) -> tuple[float, int, int, float]:
        """(document score, start and end of the worst sentence, its score)."""
        doubt, worst, at = 0.0, -math.inf, (0, 0)
        known, bias = self.words, self.bias
        usual = math.log1p(math.exp(bias)) if bias < 30 else bias
        for start, end, words in _sentences(text):
            logit = bias
            for word in words:
                value = known.get(word)
                logit += self.word(word) if value is None else value
            doubt += usual if logit == bias else (math.log1p(math.exp(logit)) if logit < 30 else logit)
            if logit > worst:
                worst, at = logit, (start, end)
        return -math.expm1(-doubt), *at, 1 / (1 + math.exp(-max(worst, -700.0)))


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> dict[str, float]:
    """Weights from at most ``bound`` labelled documents (``labels``: doc_id, toxic)."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = max(1, known.count() // (2 * bound))  # leaves about twice the bound to sort
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(bound)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `bound` ids
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))  # and rows: one text of an id

    def train_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat(batches, ignore_index=True).sort_values("doc_id", kind="stable")
        weights = train([t or "" for t in sample["text"]], sample["toxic"].to_numpy(int))
        yield pd.DataFrame({"feature": list(weights), "weight": list(weights.values())})

    trained = rows.repartition(1).mapInPandas(train_all, "feature string, weight double")
    return {r["feature"]: r["weight"] for r in trained.collect()} or {BIAS: -30.0}


def score(documents: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per document: ``doc_id``, ``score``, ``predicted``, and its worst sentence (``start``, ``end``, ``sentence_score``)."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(weights)
        for batch in batches:
            found = [scorer.score(t or "") for t in batch["text"]]
            frame = pd.DataFrame(found, columns=["score", "start", "end", "sentence_score"])
            yield frame.assign(doc_id=batch["doc_id"].array, predicted=(frame["score"] >= 0.5).astype("int32"))[["doc_id", "score", "predicted", "start", "end", "sentence_score"]]

    source = documents.select(id_text("doc_id"), F.col("text").cast("string"))
    found = source.mapInPandas(scored, "doc_id string, score double, predicted int, start long, end long, sentence_score double")
    return found.withColumn("doc_id", id_number("doc_id"))
