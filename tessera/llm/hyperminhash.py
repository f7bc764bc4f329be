"""Near-duplicate documents by HyperMinHash: compressed registers, bands, estimate, exact verification.

1. Each document's distinct five-word shingles are hashed and give ``k`` minima. A register keeps of
   its minimum the number of leading zeros and the next ``MANTISSA`` bits: 16 bits in place of 32.
2. Documents with equal shingle sets become one class, represented by their smallest id.
3. Bands of ``rows`` registers put classes into buckets. Each bucket's smallest class is its hub, and every
   other member makes a star edge to it, one edge a member and not one a pair. Edges whose
   collision-corrected estimate is not well under the limit are verified on full sets, leaf by leaf past
   their hub; components of what holds contract most groups to one node.
4. Pairs without the hub are still open in buckets whose other members are not all in one component.
   Such a bucket is cut into blocks, and the registers of each pair of blocks are compared; only members of
   pairs between components that pass the estimate come back, and only those have their sets compared, once
   however many buckets they share: by blocks of nodes with the same smallest hub. A spanning forest of the
   links leaves the task.
5. Components of all links, spread back over the classes.

No pair of a bucket is emitted as a row and no bucket is capped. A link is missed only if no band
agrees (8e-8 at similarity 0.85 and 2e-5 at 0.80 for 28 bands of 5) or its estimate falls six
standard deviations short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import cut, give_back, windows64, word_hashes
from tessera.llm.components import connected_components

BANDS, ROWS, MANTISSA = 28, 5, 10
#: Members of a block on average, and their shingles; leaves of a hub that one task compares with it.
BLOCK_DOCS, BLOCK_SHINGLES, STAR_LEAVES = 512, 1_000_000, 1_000
#: Documents asked for up to which their ids go to every task, ahead of the join that finds their texts.
BROADCAST_IDS = 500_000
_U32 = np.uint32


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words than that are one shingle, none give none."""
    return np.unique(windows64(word_hashes(text), words))


def set_key(s: np.ndarray) -> int | None:
    """Digest of a whole shingle set; null for the empty set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 31, k, np.uint32) * _U32(2) + _U32(1), rng.integers(0, 1 << 32, k, np.uint32)


def compress(least: np.ndarray) -> np.ndarray:
    """32-bit minima -> registers: leading zeros (6 bits) and the ``MANTISSA`` bits after the first one."""
    bits = np.frexp(least.astype(np.float64))[1]  # bit length; 0 for 0
    after = least.astype(np.uint64) << (np.uint64(33) - bits.astype(np.uint64))  # the leading one leaves the 32 bits
    mantissa = (after & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return (((32 - bits).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def registers(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Registers of each non-empty set: an array of sets x k."""
    a, b = _permutations(k)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(_U32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((len(sets), k), _U32)
    for j in range(k):
        least[:, j] = np.minimum.reduceat(flat * a[j] + b[j], starts)
    return compress(least)


def accident(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers of disjoint sets of n and m shingles that agree all the same.

    A minimum of n uniform values has z leading zeros with probability (1 - 2**-(z+1))**n - (1 - 2**-z)**n,
    from P(minimum >= x); two such agree in z and then, inside that range nearly uniform, in the mantissa.
    """
    z = np.arange(33)
    lead = lambda x: (1 - 2.0 ** -(z + 1)) ** x[..., None] - (1 - 2.0**-z) ** x[..., None]
    return (lead(np.asarray(n, float)) * lead(np.asarray(m, float))).sum(-1) * 2.0**-MANTISSA


def estimate(agree: np.ndarray, k: int, by_chance: np.ndarray | float = 0.5 * 2.0**-MANTISSA) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, less the share that agrees by accident."""
    return np.maximum(0, (agree / k - by_chance) / (1 - by_chance))


def least_estimate(percent: int, k: int) -> float:
    """Six standard deviations under the limit."""
    limit = percent / 100
    return limit - 6 * np.sqrt(limit * (1 - limit) / k)


def sizes_allow(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _sketch(bands: int, rows: int, words: int, more: list[str] = ()):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b["_id"].to_pylist(), b["_text"]
            at = 0
            while at < len(ids):
                sets, size = [], 0
                while at + len(sets) < len(ids) and size < 400_000:
                    sets.append(shingle_set(texts[at + len(sets)].as_py(), words))
                    size += len(sets[-1])
                full = [i for i, s in enumerate(sets) if len(s)]
                reg = registers([sets[i] for i in full], k) if full else np.zeros((0, k), np.uint16)
                regs, band = [None] * len(sets), [None] * len(sets)
                if full:
                    weight = _permutations(rows)[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    keys = (reg.reshape(len(full), bands, rows).astype(np.uint64) * weight).sum(2, dtype=np.uint64)
                    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(bands, dtype=np.uint64)
                    for r, i in enumerate(full):
                        regs[i], band[i] = reg[r].tobytes(), keys[r].view(np.int64)
                class_key = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + len(sets)], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(class_key, pa.int64()), pa.array(regs, pa.binary()), pa.array(band, pa.list_(pa.int64())), *(b[c].slice(at, len(sets)) for c in more)],
                    ["id", "n", "class_key", "registers", "bands", *more],
                )
                at += len(sets)
        give_back()

    return run


class _Forest:
    """Union-find over the members of one pair of blocks and the components they are in."""

    def __init__(self, groups: np.ndarray):
        _, first, at = np.unique(groups, return_index=True, return_inverse=True)
        self.up = first[at].tolist()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def open_pairs(part: np.ndarray, group: np.ndarray, regs: np.ndarray, n: np.ndarray, band: int | None, bands: int, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between part 0 and part 1, or inside part 0 if it stands alone, that need their sets compared; best first.

    Left out are pairs of one component, of sizes or registers too unlike, and those that an earlier band's
    bucket has too, or with ``band`` None those that no band's bucket has.
    """
    k = bands * rows
    first = np.flatnonzero(part == 0)
    second = np.flatnonzero(part == 1) if (part == 1).any() else first
    ask = (group[first][:, None] != group[second][None, :]) & sizes_allow(n[first][:, None], n[second][None, :], percent)
    if second is first:
        ask = np.triu(ask, 1)
    agree, banded = np.zeros(ask.shape, np.int16), np.zeros(ask.shape, bool)
    if ask.any():
        for j in range(bands):
            all_rows = np.ones(ask.shape, bool)
            for c in range(j * rows, (j + 1) * rows):
                same = regs[first, c][:, None] == regs[second, c][None, :]
                agree += same
                all_rows &= same
            if band is None or j < band:
                banded |= all_rows
    x, y = np.nonzero(ask & (banded if band is None else ~banded) & (agree >= k * least_estimate(percent, k)))
    fine = estimate(agree[x, y], k, accident(n[first[x]], n[second[y]])) >= least_estimate(percent, k)
    x, y = x[fine], y[fine]
    order = np.argsort(-agree[x, y], kind="stable")
    return first[x[order]], second[y[order]]


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches sorted by key; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[k].to_numpy() for k in key]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = (np.flatnonzero(change) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            now = tuple(c[lo] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


_LINKS = "a long, b long"


def _likely(stars: DataFrame, percent: int, k: int) -> DataFrame:
    """The star edges ``(a, b, na, nb, ra, rb)`` that sizes and registers allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b[c].to_numpy().astype(float) for c in ("na", "nb"))
            ra, rb = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, k) for c in ("ra", "rb"))
            keep = sizes_allow(na, nb, percent) & (estimate((ra == rb).sum(1), k, accident(na, nb)) >= least_estimate(percent, k))
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return stars.mapInArrow(run, _LINKS)


def _sets(asked: DataFrame, classes: DataFrame, base: DataFrame, words: int, most: int) -> DataFrame:
    """asked(node, uses) -> ``(node, uses, shingles)`` from the class's text, which is read and hashed once.

    ``most`` is how many nodes there are at most; few of them are looked for before texts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # few sets at a time
                part = b.slice(at, 256)
                sets = [shingle_set(t.as_py(), words) for t in part["_text"]]
                own = pa.array([set_key(s) == k for s, k in zip(sets, part["node"].to_pylist(), strict=True)])  # not another text of the same id
                yield pa.RecordBatch.from_arrays([part["node"], part["uses"], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "uses", "shingles"]).filter(own)
        give_back()

    named = asked.join(classes.select("node", "rep"), "node")
    if most <= BROADCAST_IDS:
        base = base.join(F.broadcast(named.select(F.col("rep").alias("_id")).distinct()), "_id", "left_semi")
    rows = named.join(base, F.col("rep") == F.col("_id")).select("node", "uses", "_text")
    return rows.mapInArrow(run, f"node long, uses {asked.schema['uses'].dataType.simpleString()}, shingles binary")


def _star_links(likely: DataFrame, classes: DataFrame, base: DataFrame, percent: int, words: int) -> DataFrame:
    """The likely star edges ``(a, b)`` that hold on full sets; leaves stream past their hub."""
    parts = likely.groupBy("b").agg(F.count("*").alias("m")).select("b", F.ceil(F.col("m") / STAR_LEAVES).cast("int").alias("parts"))
    leaves = likely.join(parts, "b").select(F.col("a").alias("node"), F.struct("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("leaf")).alias("use"))
    hubs = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("b").alias("node"), F.struct("b", "part", F.lit(0).alias("leaf")).alias("use"))
    uses = leaves.unionByName(hubs).groupBy("node").agg(F.collect_list("use").alias("uses"))
    held = _sets(uses, classes, base, words, 2 * likely.count())
    units = held.select("node", F.explode("uses").alias("use"), "shingles").select("use.b", "use.part", "use.leaf", "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for h, leaf, node, raw in zip(b["b"].to_pylist(), b["leaf"].to_pylist(), b["node"].to_pylist(), b["shingles"], strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if not leaf:
                    hub, own = h, s.copy()
                elif h == hub:
                    c = _common(own, s)
                    if 100 * c >= percent * (len(own) + len(s) - c):
                        found.append((node, h))
            yield _links(found)
        give_back()

    return units.repartition("b", "part").sortWithinPartitions("b", "part", "leaf").mapInArrow(run, _LINKS)


def _open_links(buckets: DataFrame, classes: DataFrame, base: DataFrame, comps: DataFrame, percent: int, words: int, bands: int, rows: int) -> DataFrame | None:
    """Links between components inside buckets, ``buckets(bucket, node, low)``; None where nothing is open."""
    own = buckets.where("node <> low").join(comps.select(F.col("node").alias("cnode"), "component"), F.col("node") == F.col("cnode"), "left")
    own = own.join(classes.select(F.col("node").alias("nnode"), "n"), F.col("node") == F.col("nnode")).select("bucket", "node", "low", "n", F.coalesce("component", "node").alias("group"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    several = own.groupBy("bucket").agg(F.min("group").alias("g"), F.max("group").alias("h"), F.count("*").alias("m"), F.sum("n").alias("shingles")).where("g <> h")
    # a key of its own has an exchange of its own, which the skew-join rule can split
    key = F.col("bucket").bitwiseXOR(F.lit(1)).alias("key")
    rest = cut(own.select(key, "*").join(several.select(key, blocks.alias("nb")), "key").drop("key"))
    if rest.isEmpty():
        return None
    members = rest.groupBy("node").agg(F.min("low").alias("home"), F.first("n").alias("n"), F.first("group").alias("group"))
    homes = members.groupBy("home").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).select(F.col("home").bitwiseXOR(F.lit(1)).alias("key"), blocks.alias("nb"))
    # as inside buckets, so that a bucket's blocks are mostly those of a home, and a unit asks for few others
    slot = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("slot")
    members = cut(members.withColumn("key", F.col("home").bitwiseXOR(F.lit(1))).join(homes, "key").select("node", "home", slot, "n", "group"))
    held = members.join(classes.select(F.col("node").alias("cnode"), "registers", "bands"), F.col("node") == F.col("cnode")).drop("cnode")
    # block i meets every block j >= i; a unit (lo, hi) gets both, lo = hi has one
    dealt = rest.select("bucket", F.col("node").alias("rnode"), F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("bucket", "rnode", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("part"))
    band = (F.array_position("bands", F.col("bucket")) - 1).cast("int").alias("band")
    unit = ["bucket", "lo", "hi"]
    units = dealt.join(held, F.col("rnode") == F.col("node")).select(*unit, "part", band, "node", "home", "slot", "n", "group", "registers")

    def pairs(g: pa.Table, band: int | None) -> tuple[np.ndarray, np.ndarray]:
        regs = np.frombuffer(b"".join(g["registers"].to_pylist()), np.uint16).reshape(g.num_rows, bands * rows)
        return open_pairs(g["part"].to_numpy(), g["group"].to_numpy(), regs, g["n"].to_numpy(), band, bands, rows, percent)

    meeting = ["home", "slot", "home2", "slot2"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, unit):
            x, y = pairs(g, g["band"][0].as_py())
            if len(x):
                at = np.stack([g[c].to_numpy() for c in ("home", "slot")], axis=1)
                first, second = at[x], at[y]
                swap = (first[:, 0] > second[:, 0]) | ((first[:, 0] == second[:, 0]) & (first[:, 1] > second[:, 1]))
                first[swap], second[swap] = second[swap], first[swap].copy()
                node = g["node"].to_numpy()
                each = np.unique(np.concatenate([np.column_stack([first, second, node[z], (at[z] != first).any(1)]) for z in (x, y)]), axis=0)
                keys, of = np.unique(each[:, [0, 1, 2, 3, 5]], axis=0, return_inverse=True)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of.ravel()))])
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(each[np.argsort(of.ravel(), kind="stable"), 4]))
                cols = [keys[:, k].astype(t) for k, t in enumerate((np.int64, np.int32, np.int64, np.int32, np.int32))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), nodes], [*meeting, "part", "nodes"])
        give_back()

    asked = units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(ask, "home long, slot int, home2 long, slot2 int, part int, nodes array<long>")
    # two blocks meet in the buckets that their nodes share, of which each node has a few, so this gathers little
    asked = asked.groupBy(*meeting, "part").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes"))
    asked = cut(asked.select(*meeting, "part", F.explode("nodes").alias("node")))
    if asked.isEmpty():
        return None
    uses = asked.groupBy("node").agg(F.collect_list(F.struct(*meeting, "part")).alias("uses"))
    sets = _sets(uses, classes, base, words, uses.count())
    known = held.select(F.col("node").alias("mnode"), "n", "group", "registers")
    member = sets.join(known, F.col("node") == F.col("mnode")).select(F.explode("uses").alias("use"), "node", "n", "group", "registers", "shingles").select("use.*", "node", "n", "group", "registers", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, meeting):
            x, y = pairs(g, None)
            nodes, n = (g[c].to_numpy() for c in ("node", "n"))
            sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in g["shingles"]]
            forest, found = _Forest(g["group"].to_numpy()), []
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if forest.find(i) != forest.find(j):
                    c = _common(sets[i], sets[j])
                    if 100 * c >= percent * (n[i] + n[j] - c):
                        forest.join(i, j)
                        found.append((int(nodes[i]), int(nodes[j])))
            yield _links(found)
        give_back()

    return member.repartition(*meeting).sortWithinPartitions(*meeting).mapInArrow(verify, _LINKS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, words: int = 5, bands: int = BANDS, rows: int = ROWS, text_hash: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of docs; with ``text_hash`` also xxhash64 of the text.

    Linked are documents with 100 * intersection >= percent * union of their shingle sets, confirmed
    on the full sets. component_id is the smallest id reachable over links. Documents without words
    (null or empty text too) have n_shingles 0 and stand alone. Rows are linked by their texts:
    repeated rows share a component, and of an id with several texts each row has its own text's.
    Rows whose id is null are kept, stand alone and have a null component. Words are
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Ids are integers.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    more = {"text_hash": F.xxhash64("_text")} if text_hash else {}
    sketches = cut(base.withColumns(more).mapInArrow(_sketch(bands, rows, words, [*more]), "id long, n long, class_key long, registers binary, bands array<long>" + "".join(f", {c} long" for c in more)))
    # documents with equal sets: the smallest id stands for them
    classes = sketches.where("id is not null and n > 0").groupBy(F.col("class_key").alias("node")).agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    classes = cut(classes)
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    first = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("m")).where("m > 1")
    buckets = cut(buckets.join(first, "bucket").select("bucket", "node", "low", "m"))
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    stars = buckets.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    likely = cut(_likely(stars.join(side("a"), "a").join(side("b"), "b"), percent, bands * rows))
    comps = cut(connected_components(_star_links(likely, classes, base, percent, words)))
    others = _open_links(buckets.where("m > 2"), classes, base, comps, percent, words, bands, rows)
    if others is not None:
        comps = connected_components(comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(others))
    member = comps.select(F.col("component").bitwiseXOR(F.lit(1)).alias("key"), "node").join(classes.select("node", "rep"), "node")
    lowest = member.groupBy("key").agg(F.min("rep").alias("component"))
    # a key of its own has an exchange of its own, which the skew-join rule can split
    named = member.select(F.col("key").bitwiseXOR(F.lit(2)).alias("k"), "node").join(lowest.select(F.col("key").bitwiseXOR(F.lit(2)).alias("k"), "component"), "k").select(F.col("node").alias("class_key"), "component")
    named = classes.select(F.col("node").alias("class_key"), "rep").join(named, "class_key", "left").select("class_key", F.coalesce("component", "rep").alias("component"))
    own = F.col("class_key").bitwiseXOR(F.lit(1)).alias("key")
    out = sketches.select("id", "n", own, *more).join(named.select(own, "component"), "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = out.select("id", "n", component.cast("long").alias("component"), *more)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"), *more)
