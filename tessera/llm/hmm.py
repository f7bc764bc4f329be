"""A hidden Markov language model, trained by Baum-Welch over all partitions, and exact scores of whole texts.

Tokens are words and one end of text. Each of the most frequent words is a symbol; other words are symbols by
class, told by their last byte and length, followed by the word's own share of its class, which states have no
part in. States emit symbols, so that the model's tables have a fixed size, while counts of all words, however many,
stay in a table that rare words are joined with. Every round of Baum-Welch reads all training texts: each task sums the
expected counts of its own, Spark adds these up by symbol, and the driver makes the next tables from the sums. The
first round does so after each part of the texts, the others once.

The likelihood is the scaled forward recursion over the whole text. A long text is cut into segments that
know what lies before and behind through products of transfer matrices, which changes no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import ensure_checkpoint_dir, fresh, give_back

#: Latent states; classes of rare words; symbols with a number of two bytes, classes included.
STATES, CLASSES, SYMBOLS = 8, 64, 1 << 16
#: Parts of the training texts, after each of which the model is made anew in the first round; rounds over all texts after that one.
PARTS, ROUNDS = 8, 2
#: Weight of the words' overall distribution in each state's, in tokens, and of each transition.
PRIOR, PRIOR_STEP = 50.0, 1.0
#: Tokens worked on at a time, and of a segment; bytes of text split at a time.
BATCH_TOKENS, SEGMENT, PART_BYTES = 500_000, 65_536, 4_000_000
#: The end of a text, which is no word.
END = b"\n"
#: Buckets of counts for each doubling.
_FINE = 64


def word_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words' 64-bit numbers, and their classes."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    ends, raw = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
    return (h ^ np.uint64(1 << 63)).view(np.int64), ((raw[ends[1:] - 1] & 7) * 8 + np.minimum(np.diff(ends) // 2, 7)).astype(np.int8)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Batches in slices of about PART_BYTES, one row at least: their distinct tokens, of each token its place among these, of each row its number of tokens.

    The tokens of a text are its words with A-Z lower-cased, then the end, which stands last among the distinct ones.
    """
    for b in batches:
        texts = pc.fill_null(b["text"], "")
        part = np.cumsum(pc.binary_length(texts).to_numpy()) // PART_BYTES
        cuts = [0, *(1 + np.flatnonzero(np.diff(part))), b.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            if at == to:
                continue
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[at:to]))
            flat = lists.flatten()
            some = pc.binary_length(flat).to_numpy() > 0  # blanks around a text leave empty words
            before = np.concatenate([[0], np.cumsum(some)])
            n = np.diff(before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]) + 1
            coded = flat.filter(pa.array(some)).dictionary_encode()
            words = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
            is_end = np.zeros(n.sum(), bool)
            is_end[np.cumsum(n) - 1] = True
            places = np.full(len(is_end), len(words) - 1, np.int32)
            places[~is_end] = coded.indices.to_numpy()
            yield b.slice(at, to - at), words, places, n


def word_counts(texts: DataFrame) -> DataFrame:
    """texts(text) -> ``(h, cls, c)``: all tokens by number and class, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, places, _ in _texts(batches):
            h, cls = word_keys(words)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(cls), pa.array(np.bincount(places, minlength=len(words)))], ["h", "cls", "c"])
        give_back()

    return texts.select("text").mapInArrow(run, "h long, cls byte, c long").groupBy("h", "cls").agg(F.sum("c").alias("c"))


class Layout:
    """Sequences, longest first, with the tokens of one step side by side: step t's stand from ``off[t]`` on, ``n[t]`` of them."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0])
        self.n = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(1, steps + 1))
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        step = np.repeat(np.arange(steps), self.n)
        self.seq = np.arange(self.off[-1]) - self.off[step]
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        #: where each place's token stands in the sequences one after another; the place of each sequence's last token
        self.source = starts[self.seq] + step
        self.last = self.off[self.lengths - 1] + np.arange(len(lengths))
        self.before = self.off[step[self.n[0] :] - 1] + self.seq[self.n[0] :]


def forward(emit: np.ndarray, lay: Layout, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities of each place, and the scale factors; ``start`` has each sequence's states before its first token.

    Work goes state by state, so that a step's operations run along its sequences: ``emit`` is best the transpose of such an array.
    """
    emit, back = np.ascontiguousarray(emit.T), np.ascontiguousarray(step.T)
    alpha = np.empty_like(emit)
    scale = np.empty(emit.shape[1], emit.dtype)
    off, before = lay.off.tolist(), 0
    for a, b in zip(off, off[1:]):
        now, s = alpha[:, a:b], scale[a:b]
        if a:
            np.matmul(back, alpha[:, before : before + b - a], out=now)
            np.multiply(now, emit[:, a:b], out=now)
        else:
            np.multiply(start.T, emit[:, :b], out=now)
        np.add.reduce(now, 0, out=s)
        np.divide(now, s, out=now)
        before = a
    return alpha.T, scale


def log_likelihood(scale: np.ndarray, lay: Layout) -> np.ndarray:
    """Natural logarithm of each sequence's probability, in the order given."""
    out = np.empty(len(lay.order))
    out[lay.order] = np.bincount(lay.seq, np.log(scale), len(lay.order))
    return out


def backward(emit: np.ndarray, scale: np.ndarray, lay: Layout, step: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled backward probabilities, and each place's ``emit * beta / scale``; ``end`` has what follows each sequence's last token."""
    ratio, end, step = np.ascontiguousarray(emit.T) / scale, np.ascontiguousarray(end.T), np.ascontiguousarray(step)
    beta, ahead = np.empty_like(ratio), np.empty_like(ratio)
    off, n = lay.off.tolist(), 0
    for a, b in zip(off[-2::-1], off[:0:-1]):
        if n:
            np.matmul(step, ahead[:, b : b + n], out=beta[:, a : a + n])
        if a + n < b:
            beta[:, a + n : b] = end[:, n : b - a]
        np.multiply(ratio[:, a:b], beta[:, a:b], out=ahead[:, a:b])
        n = b - a
    return beta.T, ahead.T


def transfers(parts: list[np.ndarray], emits: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A matrix for each part, up to a factor: from states before its first token to states at its last, with the part's probability."""
    k = len(step)
    lay = Layout(np.repeat([len(p) for p in parts], k))
    codes = np.concatenate([p for p in parts for _ in range(k)])[lay.source]
    alpha, scale = forward(emits.T.take(codes, 1).T, lay, step, np.tile(np.eye(k, dtype=emits.dtype), (len(parts), 1))[lay.order])
    last = np.empty((len(lay.order), k), emits.dtype)
    last[lay.order] = alpha[lay.last]
    log = log_likelihood(scale, lay).reshape(-1, k)
    return np.exp(log - log.max(1, keepdims=True))[:, :, None] * last.reshape(-1, k, k)


class Sequences:
    """Texts as sequences of BATCH_TOKENS at most, long ones in segments."""

    def __init__(self, first: np.ndarray, step: np.ndarray, emits: np.ndarray, segment: int = SEGMENT):
        self.first, self.step, self.emits, self.segment = first, step, np.ascontiguousarray(emits.T).T, segment
        self.codes: list[np.ndarray] = []
        self.start: list[np.ndarray] = []
        self.end: list[np.ndarray] = []
        self.prior: list[np.ndarray] = []
        self.tokens = 0

    def add(self, codes: np.ndarray) -> None:
        k, ones = len(self.step), np.ones(len(self.step), self.emits.dtype)
        parts = [codes[i : i + self.segment] for i in range(0, len(codes), self.segment)]
        starts, ends, priors = [self.first], [ones], [np.zeros(k, self.emits.dtype)]
        if len(parts) > 1:
            per = max(1, BATCH_TOKENS // (self.segment * k))
            moves = np.concatenate([transfers(parts[i : i + per], self.emits, self.step) for i in range(0, len(parts), per)])
            for m in moves[:-1]:
                at = starts[-1] @ m
                priors.append(at / at.sum())
                starts.append(priors[-1] @ self.step)
            for m in moves[:0:-1]:
                ahead = self.step @ (m @ ends[-1])
                ends.append(ahead / ahead.sum())
            ends.reverse()
        self.codes += parts
        self.start += starts
        self.end += ends
        self.prior += priors
        self.tokens += len(codes)

    def ready(self) -> bool:
        return self.tokens >= BATCH_TOKENS


def expected_counts(seqs: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected numbers of first states (K), of steps between states (K x K) and of emissions (symbols x K)."""
    lay = Layout(np.array([len(c) for c in seqs.codes]))
    codes = np.concatenate(seqs.codes)[lay.source].astype(np.intp)
    emit = seqs.emits.T.take(codes, 1).T
    alpha, scale = forward(emit, lay, seqs.step, np.array(seqs.start)[lay.order])
    end = np.array(seqs.end)[lay.order]
    end /= (alpha[lay.last] * end).sum(1, keepdims=True)
    beta, ahead = backward(emit, scale, lay, seqs.step, end)
    n, prior = lay.n[0], np.array(seqs.prior)[lay.order]
    whole = prior.sum(1) == 0
    beta *= alpha
    pairs = alpha.T.take(lay.before, 1) @ ahead[n:] + prior.T @ ahead[:n]
    kept = np.zeros((len(seqs.emits), len(seqs.step)))
    for k in range(len(seqs.step)):
        kept[:, k] = np.bincount(codes, beta[:, k], len(kept))
    return beta[:n][whole].sum(0), pairs * seqs.step, kept


class Model:
    """First states, steps, and each symbol's probability in each state (symbols x K)."""

    def __init__(self, first: np.ndarray, step: np.ndarray, emits: np.ndarray):
        self.first, self.step, self.emits = first, step, emits

    @classmethod
    def start(cls, unigram: np.ndarray, states: int, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emits = unigram[:, None] * np.exp(rng.standard_normal((len(unigram), states)))
        step = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), step, emits / emits.sum(0))

    @classmethod
    def of_counts(cls, first: np.ndarray, pairs: np.ndarray, kept: np.ndarray, unigram: np.ndarray) -> Model:
        emits = (kept + PRIOR * unigram[:, None]) / (kept.sum(0) + PRIOR)
        first, pairs = first + PRIOR_STEP, pairs + PRIOR_STEP
        return cls(first / first.sum(), pairs / pairs.sum(1, keepdims=True), emits)


def train_round(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over coded(codes), summed up over all partitions."""
    k, size = len(model.step), len(model.emits)
    sent = coded.sparkSession.sparkContext.broadcast((model.first.astype(np.float32), model.step.astype(np.float32), model.emits.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, step, emits = sent.value
        emits = np.ascontiguousarray(emits.T).T
        total = [np.zeros(k), np.zeros((k, k)), np.zeros((size, k))]

        def add(seqs: Sequences) -> None:
            for t, x in zip(total, expected_counts(seqs), strict=True):
                t += x

        seqs = Sequences(first, step, emits)
        for b in batches:
            for codes in b["codes"]:
                seqs.add(np.frombuffer(codes.as_py(), np.uint16))
                if seqs.ready():
                    add(seqs)
                    seqs = Sequences(first, step, emits)
        if seqs.codes:
            add(seqs)
        some = np.flatnonzero(total[2].any(1))
        # rows of first states and steps stand under negative numbers
        at = np.concatenate([some, -1 - np.arange(k + 1)]).astype(np.int32)
        rows = np.concatenate([total[2][some], total[1], total[0][None]]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(k)]], ["symbol", *[f"s{i}" for i in range(k)]])
        give_back()

    counts = coded.select("codes").mapInArrow(run, "symbol int, " + ", ".join(f"s{i} float" for i in range(k)))
    got = counts.groupBy("symbol").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).toArrow()  # as many rows as symbols at most
    sent.unpersist()
    at, rows = got["symbol"].to_numpy(), np.stack([got[f"s{i}"].to_numpy() for i in range(k)], axis=1)
    kept = np.zeros((size, k))
    kept[at[at >= 0]] = rows[at >= 0]
    low = np.zeros((k + 1, k))
    low[-1 - at[at < 0]] = rows[at < 0]
    return low[k], low[:k], kept


def code_texts(base: DataFrame, numbers: dict[int, int]) -> DataFrame:
    """base(rid, text, ...) -> each row with ``codes``, its symbols, and its rare words ``rare`` (numbers) and ``times``."""
    order = sorted(numbers)
    sent = base.sparkSession.sparkContext.broadcast((np.array(order, np.int64), np.array([numbers[h] for h in order], np.uint16)))
    more = [c for c in base.columns if c != "text"]
    schema = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in more) + ", n_tokens long, codes binary, rare array<long>, times array<int>"
    classes_from = SYMBOLS - CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, symbols = sent.value
        for b, words, places, n in _texts(batches):
            h, cls = word_keys(words)
            at = np.searchsorted(known, h)
            held = np.append(known, 0)[at] == h
            held &= at < len(known)
            codes = np.where(held, np.append(symbols, np.uint16(0))[at], (classes_from + cls.astype(int)).astype(np.uint16))[places]
            far = np.flatnonzero(~held[places])
            row = np.repeat(np.arange(len(n)), n)[far]
            pairs, times = np.unique(row * len(words) + places[far], return_counts=True)
            off = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * len(words)), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (h[pairs % len(words)], times.astype(np.int32))]
            ends = pa.array(np.concatenate([[0], 2 * np.cumsum(n)]), pa.int32())
            made = pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in more], pa.array(n), made, *lists], [*more, "n_tokens", "codes", "rare", "times"])
        give_back()

    return base.mapInArrow(run, schema)


def score_codes(coded: DataFrame, model: Model, logs: np.ndarray, known: np.ndarray, shares: np.ndarray) -> DataFrame:
    """coded(..., codes) -> with ``hmm_log``, ``base_log`` and ``known``: what symbols give of the model's and the base score.

    ``logs`` has log10 of each symbol's count and a half (0 for classes), ``known`` whether it was met, ``shares`` log10 of the
    divisor of a rare word's share of its class (0 for words).
    """
    sent = coded.sparkSession.sparkContext.broadcast((model.first, model.step, model.emits, logs, known, shares))
    more = [c for c in coded.columns if c != "codes"]
    schema = ", ".join(f"{c} {coded.schema[c].dataType.simpleString()}" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, step, emits, logs, known, shares = sent.value
        emits = np.ascontiguousarray(emits.T).T
        for b in batches:
            all_codes = [np.frombuffer(c.as_py(), np.uint16) for c in b["codes"]]
            got = np.empty((3, len(all_codes)))
            seqs, at = Sequences(first, step, emits), []

            def flush() -> None:
                lay = Layout(np.array([len(c) for c in seqs.codes]))
                _, scale = forward(emits.T.take(np.concatenate(seqs.codes)[lay.source], 1).T, lay, step, np.array(seqs.start)[lay.order])
                got[0] += np.bincount(at, log_likelihood(scale, lay), len(all_codes)) / np.log(10)

            got[0] = 0
            for i, c in enumerate(all_codes):
                got[0, i] -= shares[c].sum()
                got[1:, i] = logs[c].sum(), known[c].sum()
                seqs.add(c)
                at += [i] * (len(seqs.codes) - len(at))
                if seqs.ready():
                    flush()
                    seqs, at = Sequences(first, step, emits), []
            if at:
                flush()
            yield pa.RecordBatch.from_arrays([*[b[c] for c in more], pa.array(got[0]), pa.array(got[1]), pa.array(got[2].astype(np.int64))], [*more, "hmm_log", "base_log", "known"])
        give_back()

    return coded.mapInArrow(run, f"{schema}, hmm_log double, base_log double, known long")


def _bucket(c: Column) -> Column:
    return F.floor(F.log2(c) * _FINE)


def frequent_words(counts: DataFrame, most: int) -> tuple[int, dict[int, int]]:
    """The bucket of counts from which on there are ``most`` words at most, and the counts of the words in these buckets, by number."""
    sizes = sorted(((r["b"], r["count"]) for r in counts.groupBy(_bucket(F.col("c")).alias("b")).count().collect()), reverse=True)  # _FINE rows a doubling
    low, total = 64 * _FINE, 0
    for b, n in sizes:
        if total + n > most:
            break
        low, total = b, total + n
    got = counts.where(_bucket(F.col("c")) >= low).select("h", "c").toArrow()
    return low, dict(zip(got["h"].to_pylist(), got["c"].to_pylist(), strict=True))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS - CLASSES, fitted: Callable[[Model], None] | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out; the model and all counts come from the others, a null
    id among them. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, ``score`` log10 of
    the model's probability of the text, its end included. Null texts are empty: the end alone. Other columns
    play no part. ``symbols`` is the largest number of words with emissions of their own, ``fitted`` gets the model.
    """
    spark = docs.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/hmm-{uuid.uuid4().hex}"
    fold = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))
    base = docs.select(F.col(doc_id).alias("doc_id"), (fold == 1).alias("held_out"), F.col(text).cast("string").alias("text"))
    word_counts(base.where("not held_out")).write.parquet(f"{place}/counts")
    counts = spark.read.parquet(f"{place}/counts")
    low, top = frequent_words(counts, symbols)
    all_words = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_tokens, n_words = all_words["n"] or 0, all_words["v"]
    rare = counts.where(_bucket(F.col("c")) < low)
    classes = {r["cls"]: (r["n"], r["v"]) for r in rare.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # CLASSES rows

    order = sorted(top, key=lambda h: (-top[h], h))
    size, at = SYMBOLS, SYMBOLS - CLASSES
    seen = np.zeros(size)
    seen[: len(order)] = [top[h] for h in order]
    logs, known, shares = np.zeros(size), np.zeros(size), np.zeros(size)
    logs[: len(order)], known[: len(order)] = np.log10(seen[: len(order)] + 0.5), 1
    for cls in range(CLASSES):
        n, v = classes.get(cls, (0, 0))
        seen[at + cls] = n
        shares[at + cls] = np.log10(n + 0.5 * (v + 1))
    used = np.zeros(size, bool)
    used[: len(order)] = used[at:] = True
    unigram = np.where(used, seen + 0.5, 0)
    unigram /= unigram.sum()

    rid = fresh(base, "rid")[0]
    coded = code_texts(base.withColumn(rid, F.monotonically_increasing_id()), {h: i for i, h in enumerate(order)})
    coded.sortWithinPartitions("n_tokens").write.parquet(f"{place}/coded")
    coded = spark.read.parquet(f"{place}/coded")
    train = coded.where("not held_out")
    texts = train.count()
    model = Model.start(unigram, states)
    if texts:
        sums: tuple[np.ndarray, ...] | None = None
        for i in range(PARTS):  # every training text is in one part
            got = train_round(train.where(F.pmod(F.xxhash64(rid), F.lit(PARTS)) == i), model)
            sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
            model = Model.of_counts(*sums, unigram)
        for _ in range(rounds):
            model = Model.of_counts(*train_round(train, model), unigram)
    if fitted:
        fitted(model)

    pairs = coded.where(F.size("rare") > 0).select(rid, F.explode(F.arrays_zip("rare", "times")).alias("x")).select(rid, F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    # most rows find a partner; words that only held-out texts have come back with none
    found = pairs.join(rare.select(F.col("h").alias("rare_h"), "c"), F.col("h") == F.col("rare_h"), "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    of_rare = found.groupBy(rid).agg(F.sum(F.col("n") * log).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("rare_known"))
    scored = score_codes(coded.select(rid, "doc_id", "held_out", "n_tokens", "codes"), model, logs, known, shares)
    both = scored.join(of_rare.withColumnRenamed(rid, "rare_rid"), F.col(rid) == F.col("rare_rid"), "left")
    extra, whole = F.coalesce("rare_log", F.lit(0.0)), float(np.log10(n_tokens + 0.5 * (n_words + 1)))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + extra - F.col("n_tokens") * whole).alias("base_score"), (F.col("hmm_log") + extra).alias("score"),
    )
