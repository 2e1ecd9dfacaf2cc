"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame and SQL functions only.

A paragraph is a line, or a sentence of one: texts are cut at line breaks and at each blank after a full stop, whatever
comes next.  A text is the set of its paragraphs' 64-bit digests.  Its sketch has three groups of cells; a digest is
added to one cell of each group.  A cell holds how many digests it has, their exclusive or, and that of their checksums.

The fingerprint of a text is its sketch of CELLS cells, whatever the text's length.  Two sketches are subtracted cell
by cell, which leaves the digests that only one of the texts has.  *Peeling* takes out digests that stand alone in a
cell, one group of cells after the other, for some turns; what a cell of one group gives up is subtracted from its
cells in the others.  The digests taken out are the difference.  Where cells are left, or the texts' numbers of digests
say that the difference will hardly fit, both texts are sketched again with more cells, hashed anew, until peeling
empties them.

Cells are rows (id, side or pair, cell, count, key, checksum), empty ones left out, and a turn is one ``explode`` and
one aggregation by cell.  The digests are dealt by id once; all turns keep that dealing, so cells never travel.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GROUPS, BASE_BITS, MAX_BITS = 3, 4, 40
CELLS = GROUPS << BASE_BITS
TURNS, MORE_TURNS, FULL = 12, 5, 0.75
EDITED = 0.35
RANGES, MOST_RANGES = 8, 1 << 14
PARAGRAPH = "\\n|(?<=[.]) "
FOUND, MINE, OTHER = -(1 << 63), -1, -2


def digests(text: str) -> Column:
    """The set of a text's paragraph digests."""
    return F.array_distinct(F.transform(F.split(text, PARAGRAPH, -1), lambda x: F.xxhash64(x)))


def cell_of(key: Column, group: int, bits: Column, trial: Column) -> Column:
    """Cell of a key in a group of 2 ** bits cells; each trial has hash functions of its own."""
    place = F.xxhash64(F.lit(group), trial, key).bitwiseAND(F.expr("shiftleft(1L, bits)") - 1)
    return place * GROUPS + group


def _summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys, "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return out.where("c <> 0 or k <> 0 or h <> 0")


def sketches(texts: DataFrame) -> DataFrame:
    """Cells (id, side, pairs, bits, trial, cell, c, k, h) of texts (id, side, pairs, bits, trial, d), d being an array of
    digests and ``pairs`` a number that is passed on."""
    keys = ["id", "side", "pairs", "bits", "trial"]
    rows = texts.select(*keys, F.explode("d").alias("k")).select(*keys, "k", F.lit(1).cast("long").alias("c"), F.xxhash64("k").alias("h"))
    places = F.array(*[cell_of(F.col("k"), g, F.col("bits"), F.col("trial")) for g in range(GROUPS)])
    return _summed(rows.withColumn("cell", F.explode(places)), keys)


PAIR = ["id", "pair", "bits", "trial"]


def subtract(cells: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Cells of the first less those of the second side of pair i, for the pairs whose bit i is set in ``pairs`` of the
    cells; both sides have sketches of one size."""
    use = F.lit(None)
    for s in {s for p in pairs for s in p}:
        uses = [F.when(F.col("pairs").bitwiseAND(1 << i) > 0, F.struct(F.lit(i).alias("pair"), F.lit(1 if p[0] == s else -1).alias("sign"))) for i, p in enumerate(pairs) if s in p]
        use = F.when(F.col("side") == s, F.array_compact(F.array(*uses))).otherwise(use)
    rows = cells.select("*", F.explode(use).alias("use"))
    return _summed(rows.select("id", "use.pair", "bits", "trial", "cell", (F.col("c") * F.col("use.sign")).alias("c"), "k", "h"), PAIR)


def peel(cells: DataFrame, turns: int, recover: list[int]) -> DataFrame:
    """(id, pair, bits, trial, n_mine, n_other, mine, other, ok): how many digests only the first and only the second side
    has, these digests for the pairs in ``recover``, and whether all cells were emptied.

    In the turn of a group each key is in one cell of it, so none is taken twice.  A key that is taken out becomes a row
    of its own, under a negative cell number, or is counted in the cell MINE or OTHER."""
    named = F.col("pair").isin(recover) if recover else F.lit(False)
    for turn in range(turns):
        g = turn % GROUPS
        alone = (F.col("cell") >= 0) & (F.col("cell") % GROUPS == g) & (F.abs("c") == 1) & (F.col("h") == F.xxhash64("k"))

        def row(cell: Column, c: Column, h: Column) -> Column:
            return F.struct(cell.cast("long").alias("cell"), c.cast("long").alias("c"), h.alias("h"))

        own = F.when(named, F.col("k").bitwiseOR(F.lit(FOUND))).when(F.col("c") == 1, F.lit(MINE).cast("long")).otherwise(F.lit(OTHER).cast("long"))
        taken = row(own, F.col("c"), F.lit(0).cast("long"))
        given = [row(cell_of(F.col("k"), o, F.col("bits"), F.col("trial")), -F.col("c"), F.col("h")) for o in range(GROUPS) if o != g]
        stays = row(F.col("cell"), F.col("c"), F.col("h"))
        cells = _summed(cells.select(*PAIR, "k", F.explode(F.when(alone, F.array(taken, *given)).otherwise(F.array(stays))).alias("x")).select(*PAIR, "k", "x.*"), PAIR)
    out = F.col("cell") < 0
    side = lambda sign: F.array_sort(F.collect_list(F.when(out & named & (F.col("c") == sign), F.col("k"))))
    count = lambda sign: F.coalesce(F.sum(F.when(out & (F.signum("c") == sign), F.abs("c"))), F.lit(0))
    return cells.groupBy(*PAIR).agg(count(1).alias("n_mine"), count(-1).alias("n_other"), side(1).alias("mine"), side(-1).alias("other"), (F.count_if(~out) == 0).alias("ok"))


def differences(sets: DataFrame, pairs: list[tuple[str, str, float]], recover: list[int] | None = None, what: str = "differences") -> DataFrame:
    """(id, pair, n_mine, n_other, mine, other): the differing digests of each pair of columns of ``sets`` (id and arrays of
    digests); the digests themselves of the pairs in ``recover`` (all, if None).

    The third entry of a pair is the share of both sides' digests that is expected to differ.  Where that is at most FULL
    times the cells of a fingerprint, the first trial subtracts the fingerprints' sketches.  Other pairs, and those that
    fail, are sketched with eight times as many cells or six for each digest if that is more, and so on; a table is
    written for each trial.  Pairs without a difference may be missing in the result."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    recover = list(range(len(pairs))) if recover is None else recover
    names = sorted({c for p in pairs for c in p[:2]})
    fits = [(F.size(a) + F.size(b)) * F.lit(share) <= FULL * CELLS for a, b, share in pairs]
    mask = reduce(lambda x, y: x + y, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fits)])
    used = lambda c: reduce(lambda x, y: x | y, [f for f, p in zip(fits, pairs, strict=True) if c in p[:2]])
    sides = F.array_compact(F.array(*[F.when(used(c), F.struct(F.lit(i).alias("side"), F.lit(BASE_BITS).alias("bits"), F.col(c).alias("d"))) for i, c in enumerate(names)]))
    texts = sets.select("id", mask.alias("pairs"), F.explode(sides).alias("x"))
    left, right = (reduce(lambda rest, i: F.when(F.col("pair") == i, F.col(pairs[i][j])).otherwise(rest), range(len(pairs)), F.lit(None)) for j in (0, 1))
    large = F.array_compact(F.array(*[F.when(~f, F.lit(i)) for i, f in enumerate(fits)]))
    todo = sets.select("*", F.explode(large).alias("pair")).select("id", "pair", left.alias("l"), right.alias("r"))
    done: list[DataFrame] = []
    trial = 0
    while True:
        dealt = texts.select("id", "x.side", "pairs", "x.bits", F.lit(trial).alias("trial"), "x.d").repartition(parts, "id")
        # in later trials sides are numbered by pair: 2 i and 2 i + 1
        numbered = [(2 * i, 2 * i + 1) for i in range(len(pairs))] if trial else [(names.index(a), names.index(b)) for a, b, _ in pairs]
        result = materialize(peel(subtract(sketches(dealt), numbered), MORE_TURNS if trial else TURNS, recover), what)
        done.append(result.where("ok").drop("ok", "bits", "trial"))
        failed = result.where("not ok").select(F.col("id").alias("__id"), F.col("pair").alias("__pair"))
        if trial:
            if not failed.head(1):
                return reduce(lambda a, b: a.unionByName(b), done)
            todo = todo.join(failed, (F.col("id") == F.col("__id")) & (F.col("pair") == F.col("__pair")), "left_semi")
        else:
            again = sets.join(failed, F.col("id") == F.col("__id")).withColumn("pair", F.col("__pair"))
            todo = todo.unionByName(again.select("id", "pair", left.alias("l"), right.alias("r")))
        trial += 1
        bits = F.greatest(F.lit(BASE_BITS + 3 * trial), F.ceil(F.log2((F.size("l") + F.size("r") + 1).cast("double"))) + trial).cast("int")
        bits = F.least(F.lit(MAX_BITS), bits)
        texts = todo.select("id", "pair", F.explode(F.array(*[F.struct((2 * F.col("pair") + j).alias("side"), bits.alias("bits"), F.col(c).alias("d")) for j, c in enumerate("lr")])).alias("x"))
        texts = texts.select("id", F.expr("shiftleft(1, pair)").alias("pairs"), "x")


def printed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(id, one text for each entry of ``columns``): name -> column of digests.  A fingerprint is the number of digests
    and the first trial's sketch: cell, count, key and checksum of each cell that is not empty."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("d")) for i, c in enumerate(columns.values())])
    cells = sketches(rows.select("id", F.explode(sides).alias("x")).select("id", "x.side", F.lit(0).alias("pairs"), F.lit(BASE_BITS).alias("bits"), F.lit(0).alias("trial"), "x.d"))

    def text(i: int) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("side") == i, F.struct("cell", "c", "k", "h"))))
        total = F.aggregate(mine, F.lit(0).cast("long"), lambda z, x: z + F.when(x["cell"] % GROUPS == 0, x["c"]).otherwise(0))
        return F.concat_ws(";", total, F.array_join(F.transform(mine, lambda x: F.concat_ws(".", x["cell"], x["c"], F.hex(x["k"]), F.hex(x["h"]))), ","))

    return cells.groupBy("id").agg(*[text(i).alias(name) for i, name in enumerate(columns)])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, id: the text of the next document in the order of doc_id, of the first after the last,
    and a number of the row.

    Rows are dealt to ranges between quantiles of doc_id, RANGES for each shuffle partition so that hashing them to
    partitions leaves those even, each sorted in its own task; every range also gets the first row of the range after
    it.  The driver sees two numbers for each range, of which there are MOST_RANGES at most.  A null doc_id comes first; rows with one
    doc_id are in the order of their texts; a null text counts as empty.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = min(MOST_RANGES, RANGES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    steps = [1 << i for i in reversed(range(max(1, len(cuts).bit_length())))]
    padded = [*cuts, *[None] * (2 * steps[0] - len(cuts))]
    bounds = "array(" + ", ".join("cast(null as bigint)" if c is None else f"{c}L" for c in padded) + ")"
    find = f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) -> if(coalesce({bounds}[p + s - 1] <= doc_id, false), p + s, p))"
    ranged = rows.withColumn("__range", F.expr(find))
    low = sorted((r["__range"], r["none"], r["low"]) for r in docs.select("doc_id").withColumn("__range", F.expr(find)).groupBy("__range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("none")).collect())
    if not low:
        return rows.withColumns({"next_text": F.lit(None).cast("string"), "id": F.lit(0).cast("long")})
    listed = json.dumps([{"in": low[i][0], "low": None if low[i][1] else low[i][2], "to": low[i - 1][0]} for i in range(len(low))])
    before = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<`in`: int, low: bigint, `to`: int>>")).alias("x")).select(F.col("x.in").alias("__in"), F.col("x.low").alias("__low"), F.col("x.to").alias("__to"))
    first = ranged.join(F.broadcast(before), (F.col("__range") == F.col("__in")) & F.col("doc_id").eqNullSafe(F.col("__low")))
    first = first.groupBy("__to").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("__to").alias("__range"), F.lit(1).alias("__after"))
    both = ranged.withColumn("__after", F.lit(0)).unionByName(first)
    order = Window.partitionBy("__range").orderBy("__after", F.asc_nulls_first("doc_id"), "text")
    number = F.shiftleft(F.col("__range").cast("long"), 40) + F.row_number().over(order)
    return both.withColumns({"next_text": F.lead("text").over(order), "id": number}).where("__after = 0").select("doc_id", "text", "next_text", "id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 (of the text with its last quarter replaced from the next document), both
    fingerprints, and the likeness of the text to the edited one and to the next document: the Jaccard similarity of
    their digests, from the difference of their sketches.

    ``removed`` and ``added`` are the digests that peeling recovered of the edit.

    A null or empty text is one empty paragraph, an empty table gives no rows, equal texts have equal fingerprints.  Rows
    that repeat a doc_id follow each other.  Of a very long text all digests are one row's array.  Other columns of
    ``docs``, however named, are not read.
    """
    n = F.char_length("text").cast("long")
    rows = with_next(docs.select("doc_id", "text")).withColumn("n_chars", n).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))"))
    rows = rows.select("id", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests("text").alias("a"), digests("edited").alias("e"), digests("next_text").alias("x"))
    rows = materialize(rows, "digests")
    found = differences(rows.select("id", "a", "e", "x"), [("a", "e", EDITED), ("a", "x", 1.0)], recover=[0])
    of = lambda pair, column: F.first(F.when(F.col("pair") == pair, F.col(column)), ignorenulls=True)
    found = found.groupBy("id").agg(of(0, "mine").alias("removed"), of(0, "other").alias("added"), *[of(i, f"n_{c}").alias(f"{c}{i}") for i in (0, 1) for c in ("mine", "other")])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "id")
    made = printed(dealt.select("id", "a", "e"), {"fingerprint": "a", "edited_fingerprint": "e"})
    out = dealt.select("id", "doc_id", "n_chars", "edited_sha256", F.size("a").alias("na")).join(made, "id").join(found, "id", "left")
    none = F.array().cast("array<bigint>")

    def likeness(pair: int) -> Column:
        mine, other = (F.coalesce(F.col(f"{c}{pair}"), F.lit(0)) for c in ("mine", "other"))
        return (F.col("na") - mine) / (F.col("na") + other).cast("double")

    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(0).alias("near_edited"), likeness(1).alias("near_next"), F.coalesce("removed", none).alias("removed"), F.coalesce("added", none).alias("added"))
