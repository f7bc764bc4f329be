"""Merkle dataset manifest by bitmap ranks.

A leaf's place in its group is the number of rows with smaller ids there, and that is read off bitmaps, not
sorted for. Each task sets the bits of its ids in words of 64, tasks' words are merged by OR, and a directory of
row counts over the words, of bounded fan-out, says how many rows lie before each word; the rest is a count of the
bits below the id's own. Only words with a bit set exist, so that sparse ids cost a word each. Leaves then stand in
slot arrays, keyed by the upper bits of the place, each of which is reduced by several levels at once; what remains of the arrays
are the slots of the next round. Roots of groups are put together in the same way.

Proofs are never shuffled: arrays are read a second time, beside what lies above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.base import cut

#: Levels that a slot array of ``2 ** LEVELS`` slots is reduced by in one round.
LEVELS = 8
#: Bits of an id inside a word, and of keys that one node of the directory spans.
WORD_BITS, NODE_BITS = 6, 9
#: Hexadecimal digits of leaves by which rows of one id are counted, and rows made from one copy at a time.
PREFIX, COPIES = 4, 4096
#: Groups up to which one row of each is sent to every task.
SENT_ROWS = 100_000


def part(c: Column) -> Column:
    """One input of a leaf: ``-`` if null, else byte count, colon, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Lower-case hex SHA-256 of a document's five parts."""
    return F.sha2(F.concat(*[part(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and what they become level by level, pairs and a last single one digested."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Of a slot's path, for each level but the last: ``<`` and the sibling on its left, ``>`` and that on its right, or nothing."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append(("<" if other < at else ">") + nodes[other] if other < len(nodes) else "")
        at >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its path of siblings lead to."""
    for x in path:
        node = digest(node) if not x else digest(x[1:], node) if x[0] == "<" else digest(node, x[1:])
    return node


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equality of columns, null being equal to null."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _before(by: list[str], order: str, what: str) -> Column:
    return F.coalesce(F.sum(what).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def directory(words: DataFrame, group: str, low: int, high: int) -> DataFrame:
    """words(group, w, n, ...) with ``base``, the rows of the group in words before w.

    Counts are summed over nodes of ``2 ** NODE_BITS`` keys, these again, until a group has at most so many; then
    what lies before a node goes down to its keys. No window spans more than a node. low and high are the
    smallest and largest w.
    """
    levels, k = [words.select(group, F.col("w").alias("k"), "n")], 0
    while (high >> NODE_BITS * k) - (low >> NODE_BITS * k) >= 1 << NODE_BITS:
        k += 1
        levels.append(levels[-1].groupBy(group, F.shiftright("k", NODE_BITS).alias("k")).agg(F.sum("n").alias("n")))
    base = levels[-1].withColumn("base", _before([group], "k", "n"))
    for below in reversed(levels[:-1]):
        above = base.select(group, F.col("k").alias("up"), F.col("base").alias("upper"))
        own = below.withColumn("up", F.shiftright("k", NODE_BITS))
        own = own.withColumn("inner", _before([group, "up"], "k", "n"))
        base = own.join(above, _same(own, above, group, "up")).select(own[group], "k", "n", (F.col("inner") + F.col("upper")).alias("base"))
    base = base.select(F.col(group).alias("b_group"), F.col("k").alias("b_k"), "base")
    return words.join(base, (F.col("w") == F.col("b_k")) & F.col(group).eqNullSafe(F.col("b_group"))).select(*words.columns, "base")


def bitmaps(ids: DataFrame, group: str) -> DataFrame:
    """ids(group, id) -> ``(group, w, bits, n, twice, base)``: each group's bitmap in words of 64 ids that have a bit set.

    n counts the word's rows, repeated ids as often as they come; ``twice`` lists the ids with more rows than one
    as ``(bit, n)``; base counts the group's rows in words before. Tasks count their own rows of an id first.
    """
    each = ids.groupBy(group, "id").agg(F.count("*").alias("n"))
    bit = F.col("id").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    each = each.select(group, F.shiftright("id", WORD_BITS).alias("w"), bit.alias("bit"), "n")
    words = each.groupBy(group, "w").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("bit", "n"))).alias("twice"),
    )
    words = cut(words)
    ends = words.agg(F.min("w"), F.max("w")).first()
    return cut(directory(words, group, *(x or 0 for x in ends)))


def rank(word_bits: Column, twice: Column, base: Column, bit: Column) -> Column:
    """Rows of the group with ids before this one."""
    below = F.bit_count(word_bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))
    more = F.aggregate(F.filter(twice, lambda x: x["bit"] < bit), F.lit(0).cast("long"), lambda t, x: t + x["n"] - 1)
    return base + below + more


def _spread(rows: DataFrame, group: str) -> DataFrame:
    """Places of rows whose id comes more than once: by leaf, counted by the leaf's first digits, then inside these.

    Equal rows are one until each is given its own place, so that no task holds all rows of an id.
    """
    key = [group, "id", "start"]
    kinds = rows.groupBy(*key, "leaf", "bad").agg(F.count("*").alias("n")).withColumn("head", F.substring("leaf", 1, PREFIX))
    heads = kinds.groupBy(*key, "head").agg(F.sum("n").alias("n"))
    heads = heads.withColumn("at", F.col("start") + _before([group, "id"], "head", "n")).select(group, "id", "head", "at")
    kinds = kinds.withColumn("own", _before([group, "id", "head"], "leaf", "n"))
    placed = kinds.join(heads, _same(kinds, heads, group, "id", "head")).select(*[kinds[c] for c in (group, "id", "leaf", "bad", "n")], (F.col("at") + F.col("own")).alias("first"))
    lots = placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    lots = lots.repartition("leaf", "lot")
    inner = F.sequence(F.col("lot") * COPIES, F.least(F.col("n"), (F.col("lot") + 1) * COPIES) - 1)
    return lots.withColumn("i", F.explode(inner)).select(group, "id", "leaf", "bad", (F.col("first") + F.col("i")).alias("slot"))


def places(leaves: DataFrame, group: str) -> DataFrame:
    """leaves(group, id, leaf, bad) with ``slot``, each row's place in its group: by id, null first, of one id by leaf."""
    known = leaves.where("id is not null")
    words = bitmaps(known.select(group, "id"), group)
    empty = leaves.where("id is null").groupBy(group).agg(F.count("*").alias("n_null"))
    with_null = not empty.isEmpty()
    if with_null:
        words = meet(words, cut(empty), group, "left").withColumn("base", F.col("base") + F.coalesce("n_null", F.lit(0))).drop("n_null")
    rows = known.select(group, "id", "leaf", "bad", F.shiftright("id", WORD_BITS).alias("w"), F.col("id").bitwiseAND((1 << WORD_BITS) - 1).cast("int").alias("bit"))
    at = words.select(F.col(group).alias("b_group"), F.col("w").alias("b_w"), "bits", "twice", "base")
    fits = (F.col("w") == F.col("b_w")) & F.col(group).eqNullSafe(F.col("b_group"))
    found = rows.join(at, fits).select(group, "id", "leaf", "bad", rank(F.col("bits"), F.col("twice"), F.col("base"), F.col("bit")).alias("slot"), F.exists("twice", lambda x: x["bit"] == F.col("bit")).alias("again"))
    if not with_null and words.where(F.size("twice") > 0).isEmpty():
        return found.drop("again")
    again = found.where("again").withColumnRenamed("slot", "start").drop("again")
    nulls = leaves.where("id is null").select(group, "id", F.lit(0).cast("long").alias("start"), "leaf", "bad")
    return found.where("not again").drop("again").unionByName(_spread(again.select(group, "id", "start", "leaf", "bad").unionByName(nulls), group))


def meet(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows joined with a frame of one row a group, both having the column ``on``, null being a group.

    As many groups as ``SENT_ROWS`` go to every task, so that rows of a large group stay where they are; more are shuffled.
    """
    right = few.withColumnRenamed(on, "_on")
    right = F.broadcast(right) if few.count() <= SENT_ROWS else right
    return rows.join(right, F.col(on).eqNullSafe(F.col("_on")), how).drop("_on")


def _levels_of(size: int, most: int) -> int:
    """Levels of a tree over ``size`` nodes that one round does."""
    return min(most, max(0, size - 1).bit_length())


def _tops(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [reduce_levels(slots.values.field("node").to_pylist(), _levels_of(n, most))[-1][0] for n, slots in zip(b["size"].to_pylist(), b["slots"], strict=True)]
        names = [c for c in b.schema.names if c != "slots"]
        yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(out, pa.string())], [*names, "node"])


def _paths(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``(group, slot, path, ...)``: each slot's own path, followed by that of its array, and what else the slot holds."""
    for b in batches:
        group = b.schema.names[0]
        for i in range(b.num_rows):
            slots, up = b["slots"][i].values, b["path"][i].as_py() or []
            levels = reduce_levels(slots.field("node").to_pylist(), _levels_of(b["size"][i].as_py(), most))
            n, more = len(slots), [f.name for f in slots.type][2:]
            path = pa.array([siblings(levels, k) + up for k in range(n)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([b[group][i].as_py()] * n, pa.string()), slots.field("slot"), path, *map(slots.field, more)], [group, "slot", "path", *more])


def _arrays(nodes: DataFrame, sizes: DataFrame, group: str, levels: int) -> DataFrame:
    """nodes(group, slot, node, ...) in slot arrays ``(group, box, slots, size)``, slots in order."""
    slot = F.struct("slot", "node", *[c for c in nodes.columns if c not in (group, "slot", "node")])
    arrays = nodes.groupBy(group, F.shiftright("slot", levels).alias("box")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    return cut(meet(arrays, sizes, group))


def trees(leaves: DataFrame, sizes: DataFrame, group: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """leaves(group, slot, node, ...) and sizes(group, size) -> slot arrays of the leaves, and ``(group, subroot)``.

    Arrays come with ``path`` from their own top to the subroot, and ``subroot``.
    """
    slots = 1 << levels
    rounds, roots = [_arrays(leaves, sizes, group, levels)], []
    while True:
        tops = cut(rounds[-1].select(group, "size", "box", "slots").mapInArrow(partial(_tops, most=levels), f"{group} string, size long, box long, node string"))
        roots.append(tops.where(F.col("size") <= slots).select(group, F.col("node").alias("subroot")))
        tops = tops.where(F.col("size") > slots)
        if tops.isEmpty():
            break
        sizes = sizes.where(F.col("size") > slots).select(group, F.shiftright(F.col("size") + (slots - 1), levels).alias("size"))
        rounds.append(_arrays(tops.select(group, F.col("box").alias("slot"), "node"), sizes, group, levels))
    done = cut(reduce(DataFrame.unionByName, roots))
    own = rounds.pop().withColumn("path", F.array().cast("array<string>"))
    while rounds:
        above = own.select(group, "size", "slots", "path").mapInArrow(partial(_paths, most=levels), f"{group} string, slot long, path array<string>")
        above = above.select(F.col(group).alias("u_group"), F.col("slot").alias("u_slot"), "path")
        lower = rounds.pop()
        # groups that were done further down have nothing above
        own = lower.join(above, F.col(group).eqNullSafe(F.col("u_group")) & (F.col("box") == F.col("u_slot")), "left").drop("u_group", "u_slot")
    return meet(own, done, group), done


def _in_order(groups: DataFrame, by: str) -> tuple[DataFrame, int]:
    """groups with ``slot``, their place in ascending order of a column, null first, and their number: ranges, then rows inside each."""
    spark = groups.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = groups.repartitionByRange(n, F.col(by).asc_nulls_first()).sortWithinPartitions(F.col(by).asc_nulls_first())
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")))
    counts = {r["p"]: r["count"] for r in ranged.groupBy("p").count().collect()}  # one number a partition
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = spark.createDataFrame(starts or [(0, 0)], "p int, start long")
    return ranged.join(F.broadcast(offsets), "p").select(*groups.columns, (F.col("start") + F.col("i")).alias("slot")), total


def manifest(docs: DataFrame, divisor: int = 7, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for each row of docs(doc_id, source, lang, n_chars, text).

    Leaves ascend by doc_id inside their lang, null first; rows of one id follow by leaf, equal ones in any
    order. The root is that of the subroots, ordered by lang, null first. Rows whose crc32 of the decimal id ``divisor``
    divides are checked as if n_chars were one more; a null id or n_chars is never changed. Other columns play
    no part, whatever their names. No rows give no rows.
    """
    spark = docs.sparkSession
    text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"), leaf_digest(*text).alias("leaf"),
        F.when(hit, leaf_digest(*text[:3], more, text[4])).alias("bad"),
    )
    leaves = cut(leaves)
    sizes = cut(leaves.groupBy("lang").agg(F.count("*").alias("size")))
    slots = places(leaves, "lang").select("lang", "slot", F.col("leaf").alias("node"), "id", "bad")
    arrays, roots = trees(slots, sizes, "lang", levels)
    groups, n = _in_order(roots, "lang")
    whole = spark.createDataFrame([("", n)], "whole string, size long")
    tops, root = trees(groups.select(F.lit("").alias("whole"), "slot", F.col("subroot").alias("node"), "lang"), whole, "whole", levels)
    whole = root.first()
    if whole is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    whole = whole["subroot"]

    ways = tops.select("whole", "size", "slots", "path").mapInArrow(partial(_paths, most=levels), "whole string, slot long, path array<string>, lang string")
    ways = cut(ways.select("lang", F.col("path").alias("up")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                slots, up, sub = b["slots"][i].values, (b["path"][i].as_py() or []) + b["up"][i].as_py(), b["subroot"][i].as_py()
                nodes, bad = slots.field("node").to_pylist(), slots.field("bad").to_pylist()
                tree = reduce_levels(nodes, _levels_of(b["size"][i].as_py(), levels))
                paths = [siblings(tree, k) + up for k in range(len(nodes))]
                proof = [digest(*[x[1:] for x in p]) for p in paths]
                folded = [fold(x or y, p) for x, y, p in zip(bad, nodes, paths, strict=True)]
                cols = [slots.field("id"), pa.array(nodes), pa.array([sub] * len(nodes)), pa.array([whole] * len(nodes)), pa.array(proof), pa.array(folded), pa.array([f == whole for f in folded])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return meet(arrays, ways, "lang").select("size", "slots", "path", "up", "subroot").mapInArrow(rows, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
