"""Best-fit packing with large-item matching: documents as token pieces into as few fixed-size sequences as it can.

Lengths are integers up to the capacity, so the histogram of lengths is all that a plan needs: it has at most
``capacity`` entries however many documents there are.  The plan is made on the driver from the histogram alone, for
whole runs of equal pieces at a time; pieces then find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, materialize, without

CAPACITY = 2048
SEPARATOR = 0
GROUPS, GROUP_ROWS = 1 << 16, 1_000
_SLICE = 1 << 20
# letters and digits that all versions of Unicode take for such; marks but the apostrophe, which may begin a contraction
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωЁА-яё", r"!-&(-/:-@\[-`{-~"
_WORD = "0-9" + _LETTER
_ONE = re.compile(f" ?(?:[{_LETTER}]+|[0-9]+|[{_MARK}]+)")
_PARTS = re.compile(f"[ \n]*[{_WORD}]+(?:'[{_WORD}]+)*|[ \n]*[{_MARK}']+|[ \n]+")
_CUT = re.compile(r"(?<=[\w!-~])(?=[ \n])")
_KNOWN, _SHORT = 1 << 18, 64


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones of Latin-1 stand for themselves, the others
    for those from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of parts of texts as bytes, found when they are first asked for.  Two generations of _KNOWN parts at most are
    kept: when the younger one is full it becomes the older, from which what is still in use comes back."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array("I", self.encode(part)).tobytes()
        if len(part) <= _SHORT:
            if len(self) >= _KNOWN:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


@lru_cache(maxsize=4)
def tokenizer(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Encoder of the byte-level vocabulary in ``path`` (the public 50k file by default): text to ids of 32 bits.

    The ids come from the tokenizers library, which sees each text in parts.  A text of common letters, digits, ASCII
    marks, blanks and line breaks is cut into words and marks, each with the white space before it; any other text before
    every blank or line break that follows a letter, digit or mark.  At these places this vocabulary's rules end a token
    whatever comes next: letters, digits and marks are tokens of their own kind, and white space only begins one.
    The ids of short parts are kept for the life of a worker, so most parts of a text cost a lookup.  A ``.tiktoken``
    rank file of the same vocabulary goes to tiktoken instead."""
    import public_tokenizers as P

    path = path or P.path("byte_bpe_50k.json")
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("bytes", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(encoding.encode_ordinary(text), np.uint32)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # workers are forked, and tasks have a core each
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    model, letters = t.model, _byte_letters()

    def ids_of(part: str) -> list[int]:
        if _ONE.fullmatch(part):  # one token to be: the rules that cut texts have nothing to do
            return [x.id for x in model.tokenize(part.encode().decode("latin-1").translate(letters))]
        return t.encode(part, add_special_tokens=False).ids

    known = _Known(ids_of)

    def encode(text: str) -> np.ndarray:
        parts = _PARTS.findall(text)
        if "\n'" in text or text[:1] == "'" or "".join(parts) != text:
            parts = _CUT.split(text)
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter, all others are full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row for each piece: the columns ``keep``, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's tokens are its ids and then the separator; a null text counts as empty, so every row has a piece.
    The checksum is that of the ids as unsigned 32-bit little-endian numbers.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[c.take(pa.array(out["row"], pa.int64())) for c in columns], pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()), *([pa.array(out["ids"], pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

        for batch in batches:
            columns, texts = [batch.column(i) for i in range(len(keep))], batch.column(len(keep))
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            held = 0
            for row in range(batch.num_rows):
                ids = np.append(encode(texts[row].as_py()), np.uint32(SEPARATOR))
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    for name, value in (("row", row), ("piece", k), ("start", start), ("length", length), ("crc", zlib.crc32(part.astype("<u4").tobytes()))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
                        held += length
                if held >= _SLICE:
                    yield flush()
                    out, held = {k: [] for k in out}, 0
            if out["row"]:
                yield flush()

    return rows.mapInArrow(run, schema)


class Plan:
    """Places for all pieces, from the counts of their lengths.

    Bins live in runs: ``(first bin, how many, room left)``, all bins of a run being filled alike.
    A placement ``(length, first rank, last rank, first bin, offset)`` puts the pieces of a length with ranks from the
    first up to the last into consecutive bins at one offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.bins = capacity, 0
        self.placed: list[tuple[int, int, int, int, int]] = []
        self._rank = dict.fromkeys(counts, 0)
        self._room: dict[int, list[tuple[int, int]]] = {}
        left = {n: c for n, c in counts.items() if c > 0}
        large = sorted(n for n in left if 3 * n > capacity)
        self._match(left, large)
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._best_fit(n, left[n])

    def _put(self, n: int, how_many: int, first: int, offset: int) -> None:
        rank = self._rank[n]
        self.placed.append((n, rank, rank + how_many, first, offset))
        self._rank[n] = rank + how_many

    def _open(self, how_many: int) -> int:
        first = self.bins
        self.bins += how_many
        return first

    def _match(self, left: dict[int, int], large: list[int]) -> None:
        """Pieces of over a third of the room: the largest takes the largest partner that still fits, two at most in a bin."""
        while large:
            n = large[-1]
            if not left[n]:
                large.pop()
                continue
            partner = next((m for m in reversed(large) if left[m] and m + n <= self.capacity and (m != n or left[n] > 1)), None)
            if partner is None:
                k = left[n]
                first = self._open(k)
                self._put(n, k, first, 0)
                self._keep(first, k, self.capacity - n)
            elif partner == n:
                k = left[n] // 2
                first = self._open(k)
                self._put(n, k, first, 0)
                self._put(n, k, first, n)
                self._keep(first, k, self.capacity - 2 * n)
                left[n] -= 2 * k
                continue
            else:
                k = min(left[n], left[partner])
                first = self._open(k)
                self._put(n, k, first, 0)
                self._put(partner, k, first, n)
                self._keep(first, k, self.capacity - n - partner)
                left[partner] -= k
            left[n] -= k

    def _keep(self, first: int, how_many: int, room: int) -> None:
        if room and how_many:
            self._room.setdefault(room, []).append((first, how_many))

    def _best_fit(self, n: int, count: int) -> None:
        while count:
            room = min((r for r in self._room if r >= n), default=None)
            if room is None:
                each = min(count, self.capacity // n)
                k = count // each
                first = self._open(k)
                for i in range(each):
                    self._put(n, k, first, i * n)
                self._keep(first, k, self.capacity - each * n)
                count -= k * each
                continue
            runs = self._room[room]
            first, how_many = runs.pop()
            if not runs:
                del self._room[room]
            each = min(count, room // n)
            k = min(how_many, count // each)
            for i in range(each):
                self._put(n, k, first, self.capacity - room + i * n)
            self._keep(first, k, room - each * n)
            self._keep(first + k, how_many - k, room)
            count -= k * each

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (length << 40 | first rank) and rows (first rank, first bin, offset)."""
        rows = np.array(sorted(self.placed), np.int64).reshape(-1, 5)
        return rows[:, 0] << 40 | rows[:, 1], rows[:, [1, 3, 4]]


def place(parts: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length``.

    Ranks among pieces of one length come from row numbers in salted groups: a length has as many hash groups as make
    them GROUP_ROWS rows each or, of many rows, a GROUPS-th of all.  The driver gets the histogram of lengths (at most
    ``capacity`` numbers), then the groups' sizes (at most GROUPS + ``capacity``), which say where each group starts, and
    broadcasts those and the plan: some 4 MB at most, however many pieces there are.
    """
    order = order or ["doc_id", "piece"]
    parts = without(parts, "sequence_id", "offset")
    salt, many, place_in, same = free_names(parts, "__salt", "__salts", "__in", "__length")
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(GROUP_ROWS, -(-sum(counts.values()) // GROUPS))
    # from an Arrow table, which the JVM reads itself: from Python rows, executors would start workers of another kind for it
    salts = spark.createDataFrame(pa.table({same: pa.array([*counts], pa.int64()), many: pa.array([-(-c // each) for c in counts.values()], pa.int32())}))
    salted = parts.join(F.broadcast(salts), F.col("length") == F.col(same)).withColumn(salt, F.pmod(F.xxhash64(*order), F.col(many)).cast("int")).drop(many, same)
    groups = sorted((r["length"], r[salt], r["n"]) for r in salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n")).collect())
    before, sums = [], {}
    for length, _, n in groups:
        before.append(sums.get(length, 0))
        sums[length] = sums.get(length, 0) + n
    plan = Plan(sums, capacity)
    shared = spark.sparkContext.broadcast((np.array([x << 32 | y for x, y, _ in groups], np.int64), np.array(before, np.int64), *plan.table()))
    from pyspark.sql import Window

    ranked = salted.withColumn(place_in, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)) - 1)
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, keys, rows = shared.value
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
            length = get("length")
            if not len(length):
                continue
            rank = get(place_in) + start[np.searchsorted(group, length << 32 | get(salt))]
            row = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(row[:, 1] + rank - row[:, 0]), pa.array(row[:, 2])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, parts.schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Tokenizing runs once: its rows are written to the shared folder, and all later steps read those.
    * null and empty texts: one piece of the separator alone; an empty table gives no rows.
    * repeated rows are packed each on their own; equal (doc_id, piece) take places in any order among themselves.
    * a very long text is cut into pieces; its ids are in memory at once, as a row's text is.
    * other columns of ``docs``, however named, are not read.
    """
    parts = materialize(pieces(docs, capacity, path, with_ids), "pieces")
    return place(parts, capacity)
