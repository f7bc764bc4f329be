"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

1. Lexicon voters hold words, pattern voters hold word beginnings; what they hold is mined from the
   labelled rows that may be learnt from, up to a bound. One more
   pattern voter looks for runs of marks. Each voter says toxic or keeps silent.
2. The label model takes no labels. On the counts of all learnable documents' vote patterns it fits a
   mixture of two classes by EM, which gives each voter's hit rates in both; correlations come from the
   pairs' residuals, and voters that move together share one voice in the posterior.
3. A logistic regression learns the posteriors on a bounded sample, from the words and beginnings
   themselves, and scores every document.

Texts are read twice: labelled ones for their features, all for the features of the model alone, from which
both the votes and the score follow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import Memo, cut, give_back

#: Labelled rows that words are mined from at most, rows the regression is fitted on at most, and voters of
#: each kind. All are bounds, not shares; so the number of features is bounded too.
LABELLED_ROWS, SAMPLE_ROWS, LEXICONS, PATTERNS = 60_000, 20_000, 6, 4
#: Toxic rows a feature needs (and 0.5 % of them), and log-odds from which it counts as toxic.
LEAST_ROWS, LEAST_ODDS = 3, 2.5
#: Log-likelihood ratio of a feature against no association, at least; 3 more for each tenfold of 35
#: toxic rows, as more features then stand by chance.
LEAST_RATIO = 13.0
BEGINNINGS = (4, 5, 6, 7, 8)
_FOLD = bytes.maketrans(bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F)), b" " * 32)


def _features_of(word: bytes) -> tuple[str, tuple[str, ...]]:
    w = word.decode("utf-8", "replace")
    return w, tuple(f"{w[:n]}*" for n in BEGINNINGS if len(w) > n)


def _words(text: str | None) -> tuple[Counter, float]:
    """Words with their numbers, and the number from which a beginning is dense."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()
    return Counter(words), max(2, len(words) / 100)


def features(text: str | None, memo: Memo) -> set[str]:
    """A text's distinct words, lower-cased and without ASCII punctuation, and dense beginnings as ``abcd*``.

    A beginning is dense if two words or more, and one in a hundred at least, start with it.
    """
    words, least = _words(text)
    out, begun = set(), {}
    for w, n in words.items():
        name, starts = memo[w]
        out.add(name)
        for s in starts:
            begun[s] = begun.get(s, 0) + n
    out.update(s for s, n in begun.items() if n >= least)
    return out


class FeatureReader:
    """Reads off texts which of some known features they have, as sorted numbers; other words cost a look-up only."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.memo = Memo(self._known, 50_000)

    def _known(self, word: bytes) -> tuple[int | None, list[int]] | None:
        w, starts = _features_of(word)
        own, begun = self.index.get(w), [self.index[s] for s in starts if s in self.index]
        return (own, begun) if own is not None or begun else None

    def read(self, text: str | None) -> list[int]:
        words, least = _words(text)
        memo, out, begun = self.memo, set(), {}
        for w, n in words.items():
            if (known := memo[w]) is not None:
                own, starts = known
                if own is not None:
                    out.add(own)
                for s in starts:
                    begun[s] = begun.get(s, 0) + n
        out.update(s for s, n in begun.items() if n >= least)
        return sorted(out)


def learnable(doc_id):
    """Rows whose labels may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


@dataclass
class Model:
    """Everything that scoring needs; sizes are bounded by the parameters above."""

    voters: dict[str, int]
    weights: dict[str, float]
    bias: float
    clean_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))
    toxic_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: float = 0.0


def association(labelled: DataFrame, least: int = LEAST_ROWS, odds: float = LEAST_ODDS) -> list[tuple[str, int, int, float]]:
    """Features of toxic rows: (feature, toxic rows, clean rows, smoothed log-odds), the strongest first.

    Counted over all rows of ``labelled(text, toxic)``; counts are summed in each task before the shuffle. A
    feature needs toxic rows, odds and a ratio that chance doesn't give, so that few of a bounded number
    of rows' features come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held = Memo(_features_of, 30_000), [Counter(), Counter()]

        def out():
            names = [*held[0].keys() | held[1].keys()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in held)], ["feature", "clean", "toxic"])
            held[0].clear()
            held[1].clear()

        for b in batches:
            for t, y in zip(b["text"], b["toxic"].to_pylist(), strict=True):
                held[y].update(features(t.as_py(), memo))
                if len(held[0]) + len(held[1]) > 150_000:
                    yield from out()
        if held[0] or held[1]:
            yield from out()
        memo.clear()
        give_back()

    n_clean, n_toxic = (float(x or 0) for x in labelled.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first())
    counts = labelled.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    score = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    best = counts.where(F.col("toxic") >= max(least, 0.005 * n_toxic)).withColumn("odds", score).where(F.col("odds") >= odds)
    n, share = F.col("toxic") + F.col("clean"), n_toxic / max(1.0, n_toxic + n_clean)
    excess = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * F.lit(p)))).otherwise(0.0)
    best = best.withColumn("ratio", 2 * (excess("toxic", share) + excess("clean", 1 - share))).where(F.col("ratio") >= LEAST_RATIO + 3 * np.log10(max(1.0, n_toxic / 35)))
    return [(r["feature"], r["toxic"], r["clean"], r["odds"]) for r in best.orderBy(F.desc("ratio"), "feature").collect()]


def assign_voters(found: list[tuple[str, int, int, float]], lexicons: int = LEXICONS, patterns: int = PATTERNS) -> dict[str, int]:
    """Feature -> voter; words go to the lexicons, beginnings to the patterns, by digest."""
    place = lambda f, n: xxhash.xxh3_64_intdigest(f) % n
    return {f: lexicons + place(f, patterns) if f.endswith("*") else place(f, lexicons) for f, *_ in found}


_LOUD = re.compile(r"[!?]{2,}|[#$%&*]{2,}")


def loud(text: str | None) -> bool:
    """Whether a text has three runs of marks or more."""
    return len(list(islice(_LOUD.finditer(text or ""), 3))) == 3


def votes(text: str | None, cols: list[int], voter_of: list[int], n: int) -> np.ndarray:
    """1 toxic, 0 none; the last voter is a pattern voter for runs of marks."""
    out = np.zeros(n + 1, np.int8)
    for c in cols:
        out[voter_of[c]] = 1
    out[n] = loud(text)
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Fit P(toxic), the voters' hit rates in both classes, and their correlations within a class, from vote patterns.

    EM for a two-class mixture of voters. Toxic is the class in which more voters speak. What the rates
    leave unexplained of the pairs gives the correlations, by which ``posterior`` counts voters that move
    together as one voice. No labels are used. EM doesn't go on from that posterior: it is no likelihood,
    and both classes would run into one.
    """
    x, c = patterns.astype(float), counts.astype(float)
    total = c.sum()
    spoke = x[:, :-1].sum(1) if x.shape[1] > 1 else x.sum(1)
    post = np.clip(spoke / max(1.0, spoke.max()) * 0.9 + 0.05, 0.05, 0.95) * (spoke > 0) + 0.02 * (spoke == 0)
    prior, hit, miss = 0.1, None, None
    for _ in range(steps):
        w1, w0 = c * post, c * (1 - post)
        prior = float(np.clip(w1.sum() / total, 1e-4, 0.9999))
        hit = (w1 @ x + 0.5) / (w1.sum() + 1)
        miss = (w0 @ x + 0.05) / (w0.sum() + 1)
        new = posterior(x, prior, hit, miss, np.eye(x.shape[1]))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    r = x - (post[:, None] * hit + (1 - post)[:, None] * miss)
    cov = (r * c[:, None]).T @ r / total
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return prior, hit, miss, cov / np.outer(sd, sd)


def posterior(x: np.ndarray, prior: float, hit: np.ndarray, miss: np.ndarray, correlation: np.ndarray) -> np.ndarray:
    """P(toxic) of vote rows; a voter's say is divided by the weight of the voters it moves together with.

    A silent voter says nothing, as its words may belong to another language; only where all but the
    last are silent does their silence count.
    """
    share = 1 / np.maximum(1, np.where(np.abs(correlation) > 0.3, np.abs(correlation), 0).sum(1))
    said, quiet = np.log(hit / miss) * share, np.log((1 - hit) / (1 - miss)) * share
    logit = np.log(prior / (1 - prior)) + x @ said + np.where(x[:, :-1].any(1), 0, (1 - x) @ quiet)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit_linear(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, size: int, steps: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, weighted sparse binary rows, by full-batch Adam."""
    weight = weight / weight.sum()
    mean = float(weight @ y)
    w, b = np.zeros(size), float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    m = v = np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(rows)) + b, -60, 60)))
        g = np.append(np.bincount(flat, (weight * (p - y))[owner], size) + decay * w, weight @ (p - y))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _vote(docs: DataFrame, names: list[str], voter_of: list[int], size: int, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, learnable, h, votes, cols)`` of each row, from one reading of its whole text."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FeatureReader(names)
        for b in batches:
            keys, cols = [], []
            for t in b["text"]:
                s = t.as_py()
                cols.append(reader.read(s))
                keys.append(votes(s, cols[-1], voter_of, size).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["learnable"], b["h"], pa.array(keys, pa.binary()), pa.array(cols, pa.list_(pa.int32()))], ["doc_id", "learnable", "h", "votes", "cols"])
        reader.memo.clear()
        give_back()

    own = F.coalesce(F.col(doc_id).isNotNull() & learnable(doc_id), F.lit(False))
    base = docs.select(F.col(doc_id).alias("doc_id"), own.alias("learnable"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).alias("text"))
    return base.mapInArrow(vote, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, learnable boolean, h long, votes binary, cols array<int>")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, labelled_rows: int = LABELLED_ROWS) -> tuple[Model, DataFrame | None]:
    """Train on the rows of docs that ``learnable`` allows; see the module's text. Also what ``_vote`` read off all rows.

    Associations come from the ``labelled_rows`` labelled learnable ids with the smallest hashes, whose
    labels, a table of bounded size, go to every task; vote patterns from all learnable rows. The
    regression takes the ``sample_rows`` learnable rows with the smallest hashes of their ids, half
    of them with some vote: a bound, not a share, so that the driver's memory does not grow.
    """
    own = docs.where(F.col(doc_id).isNotNull() & learnable(doc_id)).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = known.where(learnable("_id")).orderBy(F.xxhash64("_id"), "_id").limit(labelled_rows)
    found = association(own.join(F.broadcast(known), "_id"))
    if not found:
        rate = known.agg(F.avg("toxic")).first()[0] or 0.1
        return Model({}, {}, float(np.log(np.clip(rate, 0.01, 0.49) / (1 - np.clip(rate, 0.01, 0.49))))), None
    voters, names, size = assign_voters(found), [f for f, *_ in found], LEXICONS + PATTERNS
    every = cut(_vote(docs, names, [voters[f] for f in names], size, doc_id, text))
    voted = every.where("learnable")
    seen = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()  # a row a pattern: 2 ** voters at most
    patterns, counts = np.array([np.frombuffer(r["votes"], np.int8) for r in seen]), np.array([r["n"] for r in seen])
    prior, hit, miss, correlation = label_model(patterns, counts)
    rows, soft, weight = [], [], []
    quiet = F.size("cols") == 0
    for part in (voted.where(~quiet), voted.where(quiet)):
        taken = part.orderBy("h", "votes", "cols").limit(sample_rows // 2).select("votes", "cols").collect()
        p = posterior(np.array([np.frombuffer(r["votes"], np.int8) for r in taken]).reshape(len(taken), -1), prior, hit, miss, correlation) if taken else np.zeros(0)
        rows += [list(r["cols"]) for r in taken]
        soft.append(p)
        weight.append(np.full(len(taken), part.count() / max(1, len(taken))))
    w, b = fit_linear(rows, np.concatenate(soft), np.concatenate(weight), len(names))
    return Model(voters, dict(zip(names, w.tolist(), strict=True)), b, miss, hit, correlation, prior), every


def _logits(texts, reader: FeatureReader, weights: list[float], bias: float) -> np.ndarray:
    return np.array([bias + sum(weights[c] for c in reader.read(t.as_py())) for t in texts], float)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``: P(toxic) of every whole text; null and empty texts get the score of no features."""
    names, weights, bias = [*model.weights], [*model.weights.values()], model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FeatureReader(names)
        for b in batches:
            logit = _logits(b["_text"], reader, weights, bias)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))), pa.float64())], ["doc_id", "score"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of docs, repeated rows and null ids too.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0; held_out marks the
    others (null for a null id). An id with several labels counts as toxic if one of them is 1. Null and
    empty texts have no features. Without any usable label every row gets the prior. Other columns play
    no part.
    """
    model, every = train(docs, labels, doc_id, text)
    if every is None:
        out = score(docs, model, doc_id, text)
    else:
        # what the vote pass read off a text is what its score is made of
        weights = F.lit(np.array([*model.weights.values()]))
        logit = F.aggregate("cols", F.lit(model.bias), lambda s, c: s + F.element_at(weights, c + 1))
        out = every.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))).alias("score"))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; rows with a null id are scored by their text like others.

    Texts are read once more, for the model's features only, as that costs less than to keep or join them.
    """
    model, _ = train(docs, labels, doc_id, text)
    weights, bias, names, schema = [*model.weights.values()], model.bias, docs.columns, [*model.weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FeatureReader(schema)
        for b in batches:
            yield b.select(names).filter(pa.array(_logits(b[text], reader, weights, bias) < 0, pa.bool_()))
        reader.memo.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)
