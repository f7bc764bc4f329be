"""Hard negatives by angular triangle filtering.

Each vector's angles to a few reference directions are stored. By the triangle inequality on the sphere the angle
between two vectors is at least the difference of their angles to a direction and at most their sum, so that
every direction gives an interval of their cosine, and with their norms one of their score. Rows stand in windows
of one label, sorted by nearest direction and angle; a window is scored, in integers, only for the anchors
whose interval with it overlaps the scores asked for. First that is the best of the anchor's own label, from a
score on that its own window guarantees, then what lies between half and 95 percent of a positive's score.

Equal vectors of one label are searched as one, so that a very common vector is one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.base import cut, ensure_checkpoint_dir, give_back

#: Reference directions of each vector length, and distinct vectors they are fitted on at most.
DIRECTIONS, SAMPLE = 16, 2_048
#: Rows of a window, anchors of a block and scored at a time, windows that a block meets in one group on average.
WINDOW, BLOCK, STEP, TOGETHER = 1_024, 1_024, 256, 16
#: Rows of one range of windows, and ranges at most.
RANGE_ROWS, RANGES = 4_096, 20_000
#: Radians that bounds are widened by, more than stored angles are off, and the same for scores, in parts.
SLACK, PART = 4e-6, 1e-9
#: Blocks whose bounds are sent to every task.
SENT_BLOCKS = 50_000
#: Below this product of norms, double precision holds every partial sum.
EXACT = 2.0**52


def taking_part(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, q)``: rows with an id, a label and a vector of finite components, one or more, one row an id.

    q holds floor(256 x), as a long. Where 7 divides the id, label becomes (label + 1) % 10. Of an id with several rows
    the smallest by label, then q, stays.
    """
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    key = F.col(vec_id).cast("long")
    turned = F.when(key % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)).cast("long")
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(embedding) > 0)).select(key.alias("vec_id"), turned.alias("label"), x.alias("x")).where(fine)
    q = F.transform("x", lambda v: F.floor(v * 256).cast("long"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", q.alias("q"))).alias("r")).select("vec_id", "r.label", "r.q")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-300, np.linalg.norm(x, axis=1))[:, None]


def fit_directions(x: np.ndarray, count: int = DIRECTIONS, steps: int = 10, seed: int = 3) -> np.ndarray:
    """Unit directions by k-means on the sphere."""
    rng, x = np.random.default_rng(seed), unit(x.astype(np.float64))
    c = x[rng.choice(len(x), count, replace=len(x) < count)] + 1e-3 * rng.standard_normal((count, x.shape[1]))
    for _ in range(steps):
        at = np.argmax(x @ unit(c).T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(np.linalg.norm(total, axis=1)[:, None] > 1e-9, total, c)
    return unit(c)


def directions_of(fitted: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The directions of a vector length; random ones for a length that no sampled vector has."""
    if dim not in fitted:
        fitted[dim] = unit(np.random.default_rng(dim).standard_normal((DIRECTIONS, dim)))
    return fitted[dim]


def angles(x: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to the directions (float32), and norms; a zero vector's angles are 0."""
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    cos = np.divide(x @ directions.T, norm[:, None], out=np.ones((len(x), len(directions))), where=norm[:, None] > 0)
    return np.arccos(np.clip(cos, -1, 1)).astype(np.float32), norm


def score_bounds(a: np.ndarray, a_norm: np.ndarray, low: np.ndarray, high: np.ndarray, n_low: float, n_high: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each anchor's scores with rows whose angles lie between low and high and norms between n_low and n_high.

    Bounds hold whatever was rounded: angles are widened by SLACK and scores by PART of the norms' product and one.
    """
    near = np.maximum(np.maximum(low - a, a - high), 0).max(1)
    far = np.minimum(a + high, 2 * np.pi - a - low).min(1)
    top, bottom = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(far + SLACK, np.pi))
    room = PART * a_norm * n_high + 1
    return a_norm * np.where(top > 0, top * n_high, top * n_low) + room, a_norm * np.where(bottom > 0, bottom * n_low, bottom * n_high) - room


def _pack(x: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them."""
    most = np.abs(x.astype(np.float64)).max()
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (n * dim)}").reshape(n, dim)


def _stack(vecs: list[bytes], dim: int) -> np.ndarray:
    """Vectors packed one by one, as one array of integers."""
    return np.stack([_unpack(v, 1, dim)[0] for v in vecs]).astype(np.int64)


def scores(a: np.ndarray, x: np.ndarray, big: bool) -> np.ndarray:
    """Exact integer inner products: by doubles where these hold every sum, else by integers of any size."""
    return a.astype(object) @ x.T.astype(object) if big else a.astype(np.float64) @ x.T.astype(np.float64)


def best_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, the first one of equal ones first: columns and values, -inf where there are no more."""
    s, rows, cols, vals = s.copy(), np.arange(len(s)), [], []
    for _ in range(min(k, s.shape[1])):
        c = s.argmax(1)
        cols.append(c)
        vals.append(s[rows, c])
        s[rows, c] = -np.inf
    return np.stack(cols, 1), np.stack(vals, 1)


def _coded(groups: DataFrame, fitted) -> DataFrame:
    """groups(rep, label, n, asked, q) -> with dim, near (direction), angle to it, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(fitted.value)
        for b in batches:
            out = []
            for q in b["q"]:
                x = q.values.to_numpy()
                a = angles(x[None], directions_of(known, len(x)))[0][0]
                out.append((len(x), int(a.argmin()), float(a.min()), _pack(x)))
            cols = [*zip(*out, strict=True)] or [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b["rep"], b["label"], b["n"], b["asked"], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["rep", "label", "n", "asked", "dim", "near", "angle", "vec"])

    return groups.select("rep", "label", "n", "asked", "q").mapInArrow(run, "rep long, label long, n int, asked boolean, dim int, near int, angle double, vec binary")


_WINDOW = "win long, dim int, label long, rows int, low array<float>, high array<float>, n_low double, n_high double, reps binary, vecs binary, asked array<int>, least array<double>"


def _windows(coded: DataFrame, fitted, k: int) -> DataFrame:
    """Sorted rows in windows of one label and length, with bounds of angles and norms, and, for each anchor in it, a score that ``k`` ids of the window reach."""

    def window(at: int, rows: list[tuple], known: dict[int, np.ndarray]) -> dict:
        dim, label = rows[0][:2]
        rows.sort(key=lambda r: r[2])
        x = _stack([r[4] for r in rows], dim)
        ang, norm = angles(x, directions_of(known, dim))
        asked = [i for i, r in enumerate(rows) if r[5]]
        least = []
        for i in range(0, len(asked), STEP):
            s = scores(x[asked[i : i + STEP]], x, norm.max() ** 2 >= EXACT).astype(np.float64)
            order = np.argsort(-s, axis=1)
            ids = np.cumsum(np.array([r[3] for r in rows])[order], axis=1)
            enough = np.minimum((ids < k).sum(1), len(rows) - 1)
            got = np.take_along_axis(s, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
            got = got - np.abs(got) * 1e-12  # of integers beyond doubles
            least += np.where(ids[:, -1] >= k, got, -np.inf).tolist()
        return {
            "win": at, "dim": dim, "label": label, "rows": len(rows), "low": ang.min(0), "high": ang.max(0), "n_low": norm.min(), "n_high": norm.max(),
            "reps": np.array([r[2] for r in rows], np.int64).tobytes(), "vecs": _pack(x), "asked": asked, "least": least,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, held, at = dict(fitted.value), [], TaskContext.get().partitionId() << 32
        schema = pa.schema([("win", pa.int64()), ("dim", pa.int32()), ("label", pa.int64()), ("rows", pa.int32()), ("low", pa.list_(pa.float32())), ("high", pa.list_(pa.float32())), ("n_low", pa.float64()), ("n_high", pa.float64()), ("reps", pa.binary()), ("vecs", pa.binary()), ("asked", pa.list_(pa.int32())), ("least", pa.list_(pa.float64()))])
        for b in batches:
            for row in zip(*[b[c].to_pylist() for c in ("dim", "label", "rep", "n", "vec", "asked")], strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == WINDOW):
                    yield pa.RecordBatch.from_pylist([window(at, held, known)], schema)
                    held, at = [], at + 1
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([window(at, held, known)], schema)
        give_back()

    return coded.select("dim", "label", "rep", "n", "vec", "asked").mapInArrow(run, _WINDOW)


_ANCHOR = "rep long, dim int, label long, near int, norm double, angles binary, vec binary, least double"


def _anchors(windows: DataFrame, fitted) -> DataFrame:
    """The anchors that windows hold, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(fitted.value)
        for b in batches:
            for i in range(b.num_rows):
                at = b["asked"][i].values.to_numpy()
                dim, n = b["dim"][i].as_py(), b["rows"][i].as_py()
                x = _unpack(b["vecs"][i].as_py(), n, dim)[at]
                ang, norm = angles(x, directions_of(known, dim))
                reps = np.frombuffer(b["reps"][i].as_py(), np.int64)[at]
                cols = [pa.array(reps), pa.array([dim] * len(at), pa.int32()), pa.array([b["label"][i].as_py()] * len(at), pa.int64()), pa.array(ang.argmin(1).astype(np.int32)), pa.array(norm), pa.array([r.tobytes() for r in ang], pa.binary()), pa.array([_pack(r) for r in x], pa.binary()), b["least"][i].values]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "dim", "label", "near", "norm", "angles", "vec", "least"])

    return windows.where(F.size("asked") > 0).mapInArrow(run, _ANCHOR)


def _bounds(part: str) -> Column:
    """Upper or lower bound of the scores between a block (b_low ... of angles and norms) and a window (low, ...)."""
    apart = "array_max(transform(sequence(0, size(low) - 1), i -> greatest(low[i] - b_high[i], b_low[i] - high[i], 0)))"
    around = "array_min(transform(sequence(0, size(low) - 1), i -> least(high[i] + b_high[i], 2 * pi() - low[i] - b_low[i])))"
    room = f"({PART} * n_high * b_n_high + 1)"
    if part == "upper":
        cos = f"cos(greatest({apart} - {SLACK}, 0))"
        return F.expr(f"{cos} * if({cos} > 0, n_high * b_n_high, n_low * b_n_low) + {room}")
    cos = f"cos(least({around} + {SLACK}, pi()))"
    return F.expr(f"{cos} * if({cos} > 0, n_low * b_n_low, n_high * b_n_high) - {room}")


def _search(windows: DataFrame, anchors: DataFrame, k: int, own_label: bool) -> DataFrame:
    """``(anchor, slot, rep, score)``: for each anchor and each of its ranges of scores the ``k`` best of its own or of other labels.

    anchors have ``los`` and ``his``, the ends of their ranges, -inf and inf included.
    """
    size = anchors.groupBy("dim", "near").count().agg(F.max("count")).first()[0] or 0
    spread = max(1, -(-size // BLOCK))
    blocks = anchors.withColumn("block", F.col("near") * spread + F.pmod(F.xxhash64("rep"), F.lit(spread)).cast("int")).groupBy("dim", "block")
    angle = F.struct("rep", "label", "norm", "angles", "vec", "los", "his")
    blocks = blocks.agg(F.collect_list(angle).alias("a"), F.min("norm").alias("b_n_low"), F.max("norm").alias("b_n_high"), F.min(F.array_min("los")).alias("from"), F.max(F.array_max("his")).alias("to"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ang = [np.stack([np.frombuffer(x, np.float32) for x in a.values.field("angles").to_pylist()]) for a in b["a"]]
            ends = [pa.array([f(x, axis=0) for x in ang], pa.list_(pa.float32())) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([*b.columns, *ends], [*b.schema.names, "b_low", "b_high"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    blocks = cut(blocks.mapInArrow(bounded, f"{kind}, b_low array<float>, b_high array<float>"))
    meta, n_windows = blocks.drop("a").withColumnRenamed("dim", "b_dim"), windows.count()
    groups = max(1, -(-n_windows // TOGETHER))
    seen = windows.select("win", "dim", "low", "high", "n_low", "n_high").withColumn("w_block", F.explode(F.sequence(F.lit(0), F.lit(DIRECTIONS * spread - 1))))
    meta = F.broadcast(meta) if meta.count() <= SENT_BLOCKS else meta
    pairs = seen.join(meta, (F.col("dim") == F.col("b_dim")) & (F.col("w_block") == F.col("block")))
    pairs = pairs.where((_bounds("upper") >= F.col("from")) & (_bounds("lower") <= F.col("to"))).groupBy(F.col("win").alias("p_win")).agg(F.collect_list("block").alias("p_blocks"))
    sent = windows.select("win", "dim", "label", "rows", "low", "high", "n_low", "n_high", "reps", "vecs").join(pairs, F.col("win") == F.col("p_win"))
    sent = sent.withColumn("block", F.explode("p_blocks")).withColumn("part", F.pmod(F.xxhash64("win"), F.lit(groups)).cast("int")).drop("p_win", "p_blocks")
    asks = blocks.select("dim", "block", "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = sent.groupBy("dim", "block", "part").cogroup(asks.groupBy("dim", "block", "part"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["anchor", "slot", "rep", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        a = right["a"].combine_chunks().values
        a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
        dim = right["dim"][0].as_py()
        x, labels, norm = _stack(a.field("vec").to_pylist(), dim), a.field("label").to_numpy(), a.field("norm").to_numpy()
        ang = np.stack([np.frombuffer(v, np.float32) for v in a.field("angles").to_pylist()])
        los, his = ([np.array(v) for v in a.field(c).to_pylist()] for c in ("los", "his"))
        slots = max(map(len, los))
        lo, hi = np.full((len(x), slots), np.inf), np.full((len(x), slots), -np.inf)
        for i, (p, q) in enumerate(zip(los, his, strict=True)):
            lo[i, : len(p)], hi[i, : len(q)] = p, q
        big = norm.max() * max(left["n_high"].to_pylist()) >= EXACT
        best, ids = np.full((len(x), slots, k), -np.inf, object if big else np.float64), np.zeros((len(x), slots, k), np.int64)
        for w in left.to_pylist():
            top, bottom = score_bounds(ang, norm, np.array(w["low"], np.float32), np.array(w["high"], np.float32), w["n_low"], w["n_high"])
            reach = np.maximum(lo, best[:, :, -1].astype(np.float64))
            pick = np.flatnonzero(((labels == w["label"]) == own_label) & ((top[:, None] >= reach) & (bottom[:, None] <= hi)).any(1))
            if not len(pick):
                continue
            rows, reps = _unpack(w["vecs"], w["rows"], dim), np.frombuffer(w["reps"], np.int64)
            for i in range(0, len(pick), STEP):
                at = pick[i : i + STEP]
                s = scores(x[at], rows, big)
                for j in range(slots):
                    inside = np.where((s >= lo[at, j, None]) & (s <= hi[at, j, None]), s, -np.inf)
                    cols, vals = best_of(inside, k)
                    vals, keys = np.concatenate([best[at, j], vals], 1), np.concatenate([ids[at, j], reps[cols]], 1)
                    order = np.lexsort((keys, -vals), axis=-1)[:, :k] if not big else np.array([sorted(range(vals.shape[1]), key=lambda c, v=v, q=q: (-v[c], q[c]))[:k] for v, q in zip(vals, keys, strict=True)])
                    best[at, j], ids[at, j] = np.take_along_axis(vals, order, 1), np.take_along_axis(keys, order, 1)
        who, slot, c = np.nonzero(best != -np.inf)
        most = (1 << 63) - 1
        got = [min(max(int(v), -most - 1), most) for v in best[who, slot, c]]
        return pa.table([pa.array(a.field("rep").to_numpy()[who]), pa.array(slot.astype(np.int32)), pa.array(ids[who, slot, c]), pa.array(got, pa.int64())], names)

    return found.applyInArrow(scan, "anchor long, slot int, rep long, score long")


def _top(found: DataFrame, by: list[str], what: str, k: int) -> DataFrame:
    return found.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), what))).where(F.col("r") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", sample: int = SAMPLE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are rows whose id ``every`` divides; an anchor's positives are its ``positives`` best other rows of its
    label, and for each the ``negatives`` best rows of other labels with 50 p <= 100 n <= 95 p are returned, p and n being
    integer scores. Ties go to the smaller id. ``taking_part`` says which rows count; vectors of other lengths than the
    anchor's have no score with it. Scores beyond a long are given as the
    nearest long; the half and the 95 percent of scores beyond 2 ** 53 are rounded. No rows give no rows.
    Every row is a candidate and all results are exact; directions, fitted on ``sample`` distinct vectors with the
    smallest id hashes, decide only what need not be scored.
    """
    spark = vectors.sparkSession
    own = cut(taking_part(vectors, vec_id, embedding, label))
    k = positives + 1
    groups = own.withColumn("r", F.row_number().over(W.partitionBy("label", "q").orderBy("vec_id"))).where(F.col("r") <= k)
    groups = groups.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = cut(groups.select(F.col("ids")[0].alias("rep"), "ids", "label", "q"))
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    by_size: dict[int, list] = {}
    for r in groups.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("q").collect():
        by_size.setdefault(len(r["q"]), []).append(r["q"])
    if not by_size:
        return spark.createDataFrame([], empty)
    fitted = spark.sparkContext.broadcast({d: fit_directions(np.array(x, np.float64)) for d, x in by_size.items()})

    keys = groups.select(F.col("label").alias("g_label"), F.col("q").alias("g_q"), "rep")
    asks = own.where(F.col("vec_id") % every == 0).join(keys, (F.col("label") == F.col("g_label")) & (F.col("q") == F.col("g_q")))
    asks = cut(asks.select(F.col("vec_id").alias("anchor_id"), F.col("rep").alias("anchor")))
    wanted = asks.select(F.col("anchor").alias("w_rep")).distinct()
    rows = groups.join(wanted, F.col("rep") == F.col("w_rep"), "left").select("rep", "label", F.size("ids").alias("n"), F.col("w_rep").isNotNull().alias("asked"), "q")
    place = f"{ensure_checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}"
    coded = cut(_coded(rows, fitted))
    ranges = min(RANGES, max(1, -(-coded.count() // RANGE_ROWS)))
    order = ["dim", "label", "near", "angle", "rep"]
    _windows(coded.repartitionByRange(ranges, *order).sortWithinPartitions(*order), fitted, k).write.parquet(f"{place}/windows")
    windows = spark.read.parquet(f"{place}/windows")
    _anchors(windows, fitted).write.parquet(f"{place}/anchors")
    anchors = spark.read.parquet(f"{place}/anchors")

    ids = groups.select(F.col("rep").alias("g_rep"), "ids")
    best = _search(windows, anchors.select("*", F.array("least").alias("los"), F.array(F.lit(float("inf"))).alias("his")), k, True)
    best = _top(best, ["anchor"], "rep", k).join(ids, F.col("rep") == F.col("g_rep")).select("anchor", "score", F.explode("ids").alias("positive_id"))
    best = cut(_top(best, ["anchor"], "positive_id", k).select("anchor", "score", "positive_id"))
    pairs = asks.join(best.withColumnRenamed("anchor", "b_anchor"), F.col("anchor") == F.col("b_anchor")).where("anchor_id <> positive_id")
    pairs = _top(pairs, ["anchor_id"], "positive_id", positives).select("anchor_id", "anchor", "positive_id", F.col("score").alias("positive_score"))

    caps = best.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("p"))
    div = lambda x, n: F.call_function("div", x, F.lit(n))
    low = F.transform("p", lambda p: (div(p, 2) + p % 2).cast("double"))
    high = F.transform("p", lambda p: (div(p, 100) * 95 + div(p % 100 * 95, 100)).cast("double"))
    caps = caps.select("anchor", "p", low.alias("los"), high.alias("his"))
    ranged = cut(anchors.join(caps, F.col("rep") == F.col("anchor")).drop("anchor"))
    others = _search(windows, ranged, negatives, False)
    others = _top(others, ["anchor", "slot"], "rep", negatives).join(ids, F.col("rep") == F.col("g_rep")).select("anchor", "slot", "score", F.explode("ids").alias("negative_id"))
    others = _top(others, ["anchor", "slot"], "negative_id", negatives)
    of_slot = caps.select(F.col("anchor").alias("c_anchor"), F.posexplode("p").alias("c_slot", "p"))
    others = others.join(of_slot, (F.col("anchor") == F.col("c_anchor")) & (F.col("slot") == F.col("c_slot")))
    others = others.select(F.col("anchor").alias("o_anchor"), "p", F.col("r").cast("int").alias("rank"), "negative_id", F.col("score").alias("negative_score"))
    out = pairs.join(others, (F.col("anchor") == F.col("o_anchor")) & (F.col("positive_score") == F.col("p")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
