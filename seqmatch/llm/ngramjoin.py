"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every text becomes its set of distinct word shingles.  Texts with one set are one *node*, so copies, however many,
   are one row from here on.
2. Nodes meet where they share a band of MinHash values.  With 20 bands of 3 values, a pair at the threshold of 0.8
   meets with probability 1 - (1 - 0.8**3)**20 > 1 - 1e-6.
3. Within a bucket, MinHash values are compared some at a time.  After n values of which m agree, a pair is dropped as
   soon as the posterior probability that its similarity reaches the threshold, under a uniform prior, is below the
   tolerance.  Buckets over a fixed size are cut into blocks; each is compared with itself and with the first one.  Where
   that leaves a bucket in several connected groups, all rows outside of the largest group are compared with all rows,
   block by block, so a large bucket of near copies takes time in proportion to its size.  A task returns a spanning
   forest of the pairs that are left, never the pairs.
4. Each connected group of what is left is verified exactly: all similarities within it from the full shingle sets, in
   pairs of blocks where it is large.  A task returns the number of links of each node and a forest of the links.
5. Classes are the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, free_names, hash128, materialize, may_be_in, text_buffer
from .components import components
from .shingles import U, mix, shingle_sets

WIDTH, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 20, 3
STEP = 12
BUCKET_BLOCK, VERIFY_BLOCK, MOST_BLOCK, VERIFY_GRAMS, BLOCKS = 512, 256, 4096, 1 << 19, 64
WORD = "[^ \\t-\\r]"
_rng = np.random.RandomState(20240229)
_A = (_rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(threshold: float, tolerance: float, values: int = BANDS * ROWS) -> list[int]:
    """For n = 0..values: the fewest agreements of n with which a pair is kept.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and the probability that it is at
    least t equals that of at most m successes in n + 1 trials of probability t."""
    out = []
    for n in range(values + 1):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance or m == n:
                break
            m += 1
        out.append(m)
    return out


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, t1, t2 (hash of the text), k1, k2 (hash of the shingle set), n (its size), sig (MinHash values).

    Rows without a word are left out."""
    t1, t2 = hash128("text")
    rows = docs.where(F.col("text").rlike(WORD)).select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(3))
            for a, b, h, of in shingle_sets(raw, at, width):
                if not len(h):
                    continue
                n = np.bincount(of, minlength=b - a)
                first = np.cumsum(n) - n
                low = (h >> U(32)).astype(np.uint32)
                sig = np.empty((b - a, len(_A)), np.uint32)
                for i in range(len(_A)):
                    sig[:, i] = np.minimum.reduceat(low * _A[i] + _B[i], first)
                k1, k2 = np.add.reduceat(mix(h + U(1)), first), np.add.reduceat(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), first)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * len(_A), len(_A), dtype=np.int32)), pa.array(sig.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(3)], pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n), values], names=["doc_id", "t1", "t2", "k1", "k2", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, k1 long, k2 long, n long, sig array<int>")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number that each of 0..n-1 reaches over the pairs (i, j)."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _roots_of(n: int, hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same where ``hit`` says which of ``left`` are linked with which of ``right``."""
    low = np.arange(n, dtype=np.int32)
    while True:
        new = low.copy()
        new[left] = np.minimum(new[left], np.where(hit, low[right][None, :], n).min(axis=1))
        new[right] = np.minimum(new[right], np.where(hit, low[left][:, None], n).min(axis=0))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _survivors(left: np.ndarray, right: np.ndarray, least: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two blocks of signatures that are never pruned; i < j if both are one block."""
    values = left.shape[1]
    agree = np.zeros((len(left), len(right)), np.int16)
    for v in range(min(STEP, values)):
        agree += left[:, v][:, None] == right[:, v][None, :]
    keep = agree >= least[min(STEP, values)]
    if same:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    got = agree[i, j].astype(np.int64)
    for n in range(STEP, values, STEP):
        last = min(n + STEP, values)
        for c in range(0, len(i), 1 << 16):  # bounded memory
            s = slice(c, c + (1 << 16))
            got[s] += (left[i[s], n:last] == right[j[s], n:last]).sum(axis=1)
        ok = got >= least[last]
        i, j, got = i[ok], j[ok], got[ok]
    return i, j


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal ``key`` columns (the first ``key`` ones); rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in range(key):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        if held:
            change[0] = any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in range(key))
        cuts = np.flatnonzero(change)
        if held and not len(cuts):
            held.append(batch)
            continue
        last = int(cuts[-1]) if len(cuts) else 0
        if held or last:
            whole = [*held, *([batch.slice(0, last)] if last else [])]
            yield pa.Table.from_batches(whole).combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(t: pa.Table, key: int) -> np.ndarray:
    change = np.ones(t.num_rows, bool)
    change[1:] = False
    for c in range(key):
        x = t.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


def _dealt(rows: DataFrame, node: list[str], n_blocks: Column) -> DataFrame:
    """Give each row of a group of ``n_blocks`` blocks its place in pairs of blocks: unit_i <= unit_j, and side 0 or 1.

    A group of one block is one unit (0, 0).  Blocks are filled by a hash of the node; block i meets block j once, so a
    row goes to as many units as there are blocks."""
    rows = rows.withColumn("__blocks", n_blocks.cast("int")).withColumn("__mine", F.pmod(F.xxhash64(F.lit("block"), *node), F.col("__blocks")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return rows.select("*", F.least("__mine", "__other").alias("unit_i"), F.greatest("__mine", "__other").alias("unit_j"), (F.col("__mine") > F.col("__other")).cast("int").alias("side")).drop("__mine", "__other", "__blocks")


def candidates(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (u, v) that connect what the pairs in each bucket connect that Bayesian pruning leaves."""
    band = ", ".join(f"xxhash64({b}, {', '.join(f'sig[{b * ROWS + r}]' for r in range(ROWS))})" for b in range(BANDS))
    banded = nodes.select("k1", "k2", F.explode(F.expr(f"array({band})")).alias("band"))
    full = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    meet = banded.join(full.hint("merge"), "band")  # the list of buckets grows with the input: never broadcast
    block = "cast(pmod(xxhash64('block', k1, k2), ceil(size / {0})) as int)".format(BUCKET_BLOCK)
    first = f"transform(sequence(0, cast(ceil(size / {BUCKET_BLOCK}) as int) - 1), j -> named_struct('i', 0, 'j', j, 'side', 0))"
    other = "array(named_struct('i', mine, 'j', mine, 'side', 0), named_struct('i', 0, 'j', mine, 'side', 1))"
    units = meet.withColumn("mine", F.expr(block)).select("band", "k1", "k2", F.explode(F.expr(f"if(mine = 0, {first}, {other})")).alias("x"))
    edges = materialize(_compared(units, nodes, threshold, tolerance), "bucket-links")
    large = full.where(F.col("size") > BUCKET_BLOCK)
    if not large.head(1):
        return edges
    groups = components(edges, "bucket-groups")
    stars = groups.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    groups = groups.select("root", F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"))
    rows = banded.join(large.hint("merge"), "band").join(groups.hint("merge"), ["k1", "k2"], "left")
    rows = materialize(rows.select("band", "size", "k1", "k2", F.coalesce("root", F.struct("k1", "k2")).alias("root")), "large-buckets")
    most = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), (F.sum("n") - F.max("n")).alias("others"))
    most = materialize(most.where("others > 0"), "largest-groups")
    rows = rows.join(most.hint("merge"), "band").withColumn("mine", F.expr(block)).withColumn("few", F.expr(f"cast(ceil(others / {BUCKET_BLOCK}) as int)"))
    right = "transform(sequence(0, few - 1), i -> named_struct('i', -1 - i, 'j', mine, 'side', 1))"
    left = f"transform(sequence(0, cast(ceil(size / {BUCKET_BLOCK}) as int) - 1), j -> named_struct('i', -1 - cast(pmod(xxhash64('few', k1, k2), few) as int), 'j', j, 'side', 0))"
    units = rows.select("band", "k1", "k2", F.explode(F.expr(f"if(root = most, {right}, concat({left}, {right}))")).alias("x"))
    more = materialize(_compared(units, nodes, threshold, tolerance), "bucket-links")
    return stars.unionByName(more)  # what the first edges connect is known: they need no further rounds


def _compared(units: DataFrame, nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Spanning forests of the pairs that are never pruned within units (band, i, j): of all its rows if all have side 0,
    else of those between side 0 and side 1."""
    meet = units.select("band", F.col("x.i").alias("unit_i"), F.col("x.j").alias("unit_j"), F.col("x.side").alias("side"), "k1", "k2").join(nodes.select("k1", "k2", "sig"), ["k1", "k2"])
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = meet.repartition(parts, "band", "unit_i", "unit_j").sortWithinPartitions("band", "unit_i", "unit_j").select("band", "unit_i", "unit_j", "side", "k1", "k2", "sig")
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            side = t.column("side").to_numpy()
            bounds = _bounds(t, 3)
            sizes = np.diff(bounds)
            crossed = np.maximum.reduceat(side, bounds[:-1]) > 0
            us, vs = [], []
            for m in np.unique(sizes[(sizes <= 8) & ~crossed]):  # many small buckets at once
                if m < 2:
                    continue
                first = bounds[:-1][(sizes == m) & ~crossed]
                for a in range(m):
                    for b in range(a + 1, m):
                        i, j = first + a, first + b
                        got = np.zeros(len(i), np.int64)
                        for n in range(0, sig.shape[1], STEP):
                            last = min(n + STEP, sig.shape[1])
                            got += (sig[i, n:last] == sig[j, n:last]).sum(axis=1)
                            ok = got >= least[last]
                            i, j, got = i[ok], j[ok], got[ok]
                        us.append(i)
                        vs.append(j)
            for g in np.flatnonzero((sizes > 8) | crossed):
                a, b = bounds[g], bounds[g + 1]
                if crossed[g]:
                    x, y = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
                    i, j = _survivors(sig[x], sig[y], least, False)
                    i, j = x[i], y[j]
                else:
                    i, j = _survivors(sig[a:b], sig[a:b], least, True)
                    i, j = i + a, j + a
                root = _roots(int(b - a), i - a, j - a)
                tied = np.flatnonzero(root != np.arange(b - a))
                us.append(tied + a)
                vs.append(root[tied] + a)
            if us:
                i, j = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(k1[i]), pa.array(k2[i]), pa.array(k1[j]), pa.array(k2[j])], names=["a1", "a2", "b1", "b2"])

    edges = meet.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")  # several bands may find one edge: components() looks at it once
    return edges.select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("u"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("v"))


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: which of the sets ``left`` reach the threshold with which of ``right``."""
    n = np.array([len(s) for s in sets])
    values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    column, of = np.unique(column[shared], return_inverse=True)[1], of[shared]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = max(256, (1 << 21) // len(sets))
    total = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, total, width):
        a, b = np.searchsorted(column, [c, c + width])
        has = np.zeros((len(sets), min(width, total - c)), np.float32)
        has[of[a:b], column[a:b] - c] = 1.0
        common += has[left] @ has[right].T
    union = n[left][:, None] + n[right][None, :] - common
    return common >= threshold * union - 1e-9


def verify(docs: DataFrame, nodes: DataFrame, groups: DataFrame, width: int, threshold: float) -> DataFrame:
    """Exact links within each group: rows (u, v, texts, rows) - an edge of a forest, or (u, null) with u's links."""
    member = groups.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.col("root.k1").alias("r1"), F.col("root.k2").alias("r2")).join(nodes.drop("sig").hint("merge"), ["k1", "k2"])
    member = materialize(member, "members")
    sizes = materialize(member.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams")), "sizes")
    t1, t2 = hash128("text")
    chosen = member.select(F.col("rep").alias("__rep"), "rep1", "rep2")
    texts = docs.where(F.col("text").rlike(WORD)).select("doc_id", t1.alias("rep1"), t2.alias("rep2"), "text")
    texts = may_be_in(texts, "rep1", bitmap(chosen.select(F.col("rep1").alias("h"))), "__in").where("__in")
    chosen = chosen.hint("merge")  # it grows with the input: never broadcast
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__rep")) & (texts["rep1"] == chosen["rep1"]) & (texts["rep2"] == chosen["rep2"]), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, of in shingle_sets(*text_buffer(batch.column(0)), width):
                if not len(h):
                    continue
                n = np.bincount(of, minlength=b - a)
                first = np.cumsum(n) - n
                k1, k2 = np.add.reduceat(mix(h + U(1)), first), np.add.reduceat(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), first)
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([x.tobytes() for x in np.split(h, first[1:])], pa.binary())], names=["k1", "k2", "grams"])

    grams = texts.mapInArrow(sets, "k1 long, k2 long, grams binary").dropDuplicates(["k1", "k2"])
    # up to BLOCKS blocks of VERIFY_BLOCK sets, then as many larger ones, as far as memory allows: a row is repeated for each
    n_blocks = F.ceil(F.greatest(F.least(F.col("size") / F.lit(VERIFY_BLOCK), F.lit(float(BLOCKS))), F.col("size") / F.lit(MOST_BLOCK), F.col("grams") / F.lit(VERIFY_GRAMS)))
    rows = _dealt(member.drop("rep", "rep1", "rep2", "n").join(sizes.hint("merge"), ["r1", "r2"]), ["k1", "k2"], n_blocks).drop("size", "grams").join(grams, ["k1", "k2"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["r1", "r2", "unit_i", "unit_j"]
    rows = rows.repartition(parts, *key).sortWithinPartitions(*key).select(*key, "side", "k1", "k2", "copies", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 4):
            bounds = _bounds(t, 4)
            k1, k2, copies, side, unit_i, unit_j = (t.column(c).to_numpy() for c in ("k1", "k2", "copies", "side", "unit_i", "unit_j"))
            grams = t.column("grams").combine_chunks()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                here = [np.frombuffer(grams[i].as_buffer(), U) for i in range(a, b)]
                if unit_i[a] == unit_j[a]:
                    left = right = np.arange(b - a)
                else:
                    left, right = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
                if not len(left) or not len(right):
                    continue
                hit = _links(here, left, right, threshold)
                weight, number = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                if unit_i[a] == unit_j[a]:
                    np.fill_diagonal(hit, False)
                else:
                    number[right] += hit.sum(axis=0)
                    weight[right] += (copies[a:b][left].astype(float) @ hit).astype(np.int64)
                number[left] += hit.sum(axis=1)
                weight[left] += (hit @ copies[a:b][right].astype(float)).astype(np.int64)
                root = _roots_of(b - a, hit, left, right)
                own = np.flatnonzero(number)
                tied = np.flatnonzero(root != np.arange(b - a))
                u = np.concatenate([own, tied]) + a
                v = np.concatenate([own, root[tied]]) + a
                yield pa.RecordBatch.from_arrays([pa.array(k1[u]), pa.array(k2[u]), pa.array(k1[v]), pa.array(k2[v]), pa.array(np.concatenate([number[own], np.zeros(len(tied), np.int64)])), pa.array(np.concatenate([weight[own], np.zeros(len(tied), np.int64)]))], names=["a1", "a2", "b1", "b2", "texts", "docs"])

    return materialize(rows.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long, texts long, docs long"), "links")


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document: doc_id, t1, t2 (hash of its text), class_id, n_links, n_text_links, keeper.

    class_id is the smallest doc_id of the class; n_links counts the other documents that reach the threshold with it,
    copies included; n_text_links counts different shingle sets only; keeper marks the document that stands for its
    class (smallest doc_id, then hash of the text).
    * null, empty and blank texts have no shingles: each is a class of its own without links, and a keeper.
    * texts of fewer than ``width`` words have one shingle of all their words.
    * rows with one doc_id and text are copies of each other; only their class says so, all have the same keeper mark.
    * a class in which all doc_id are null has a null class_id.
    """
    docs = docs.select("doc_id", "text")
    sigs = materialize(signatures(docs, width), "signatures")
    by_rep = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), F.col("t1").alias("rep1"), F.col("t2").alias("rep2"))
    nodes = sigs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min(by_rep).alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.select("k1", "k2", "copies", "n", "low.rep", "low.rep1", "low.rep2", "sig"), "nodes")
    groups = components(candidates(nodes, threshold, tolerance), "candidate-groups")
    links = verify(docs, nodes, groups, width, threshold)
    numbers = links.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("linked"))
    forest = links.where("a1 <> b1 or a2 <> b2").select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("u"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("v"))
    roots = components(forest, "classes").select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "root")
    named = nodes.drop("sig", "n").join(numbers, ["k1", "k2"], "left").join(roots, ["k1", "k2"], "left").withColumn("root", F.coalesce("root", F.struct("k1", "k2")))
    named = materialize(named, "named")
    low = materialize(named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep1", "rep2")).alias("low")), "lowest")
    named = materialize(named.join(low.hint("merge"), "root").select("k1", "k2", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("linked", F.lit(0)).alias("linked"), "low"), "classes")
    mine = F.col("doc_id").eqNullSafe(F.col("low.rep")) & (F.col("t1") == F.col("low.rep1")) & (F.col("t2") == F.col("low.rep2"))
    out = sigs.drop("sig", "n").join(named, ["k1", "k2"]).select("doc_id", "t1", "t2", F.col("low.rep").alias("class_id"), (F.col("copies") - 1 + F.col("linked")).alias("n_links"), F.col("texts").alias("n_text_links"), mine.alias("keeper"))
    t1, t2 = hash128("text")
    rest = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select("doc_id", t1.alias("t1"), t2.alias("t2"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), F.lit(True).alias("keeper"))
    return out.unionByName(rest)


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` without those that another document stands for; texts without words all stay.

    Rows that repeat a doc_id and its text become one.  Only rows whose text may be one of those to go, or of a repeated
    row, are shuffled; all others stay where they are.  All columns, however named, pass through.  A very long text is
    hashed window by window; nulls, empty texts and ties are as in ``classes``."""
    t1, t2, gone, u1, u2, in_ = free_names(docs, "__t1", "__t2", "__doc", "__u1", "__u2", "__in")
    of_text = hash128("text")
    found = classes(docs, width, threshold, tolerance)
    repeated = found.where(F.col("t1").isNotNull()).groupBy("doc_id", "t1", "t2", "keeper").agg(F.count(F.lit(1)).alias("n")).where("not keeper or n > 1")
    special = materialize(repeated.select("doc_id", "t1", "t2", "keeper"), "special")
    rows = may_be_in(docs.withColumns({t1: of_text[0], t2: of_text[1]}), t1, bitmap(special.select(F.col("t1").alias("h"))), in_)
    rows = rows.withColumn(in_, F.col(in_) & F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    drop = special.where("not keeper").select(F.col("doc_id").alias(gone), F.col("t1").alias(u1), F.col("t2").alias(u2)).hint("merge")  # it grows with the input: never broadcast
    kept = rows.where(F.col(in_)).join(drop, F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(t1) == F.col(u1)) & (F.col(t2) == F.col(u2)), "left_anti")
    names = [f"`{c}`" for c in docs.columns]
    return rows.where(~F.col(in_)).select(*names).unionByName(kept.dropDuplicates(["doc_id", t1, t2]).select(*names))
