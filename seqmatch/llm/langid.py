"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of 0 to ``order`` bytes.  With frozen counts, a byte c after context s costs
``-log2(n(s, c) / (n(s) + q(s)))`` bits where the language has seen c after s (q: distinct bytes seen after s), else the
escape ``-log2(q(s) / (n(s) + q(s)))`` plus the cost of c after s without its first byte; below the empty context
all 256 bytes cost 8 bits.  A context that a language never saw costs no escape.  The language with the shortest code wins.

The trees of all languages share one table for each context length: n-gram -> one resolved cost for each language, and
context -> one escape for each language, so scoring a byte is one hash lookup for all languages nearly always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, free_names, text_buffer, without

ORDER = 4
SAMPLE_BYTES = 1_000_000
TOTAL_BYTES = 64_000_000
PART_CHARS = 16_384
MAX_PARTS = 20_000
BLOCK = 1 << 19
ADDED = ("lang_pred", "score")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Open-addressing hash table from uint64 keys to row numbers."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.rows[slot[put]] = keys[todo[put]], todo[put]
            todo, slot = todo[~put], slot[~put]
            slot = np.where(self.keys[slot] == _EMPTY, slot, (slot + 1) & ((1 << self.bits) - 1))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.rows[slot], -1)
        left = np.flatnonzero((there != keys) & (there != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            more = ~hit & (there != _EMPTY)
            left, slot = left[more], slot[more]
        return out


def grams(raw: np.ndarray, first: int, last: int, k: int) -> np.ndarray:
    """Keys of the bytes at first..last-1 with their k predecessors (those before the buffer count as 0)."""
    key = raw[first:last].astype(np.uint64)
    for t in range(1, k + 1):
        lo = first - t
        part = raw[max(lo, 0) : last - t].astype(np.uint64)
        if lo < 0:
            part = np.concatenate([np.zeros(min(-lo, last - first), np.uint64), part])
        key |= part << np.uint64(8 * t)
    return key


class Model:
    """The merged context trees of all languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        self.gram: list[Lookup] = []
        self.context: list[Lookup] = []
        if not self.langs:
            return
        joined = {}
        for lang in self.langs:
            at = np.cumsum([0, *map(len, texts[lang])])
            raw = np.frombuffer(b"".join(texts[lang]), np.uint8)
            joined[lang] = raw, np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
        before: np.ndarray | None = None
        for k in range(order + 1):
            found = {lang: np.unique(grams(raw, 0, len(raw), k)[place >= k], return_counts=True) for lang, (raw, place) in joined.items()}
            keys = np.unique(np.concatenate([x for x, _ in found.values()]))
            n = np.zeros((len(keys), len(self.langs)))
            for i, lang in enumerate(self.langs):
                n[np.searchsorted(keys, found[lang][0]), i] = found[lang][1]
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n.shape[1])), np.zeros((len(contexts), n.shape[1]))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[of])
            if k == 0:
                shorter = np.full_like(n, 8.0)
            else:
                shorter = self.cost[-1][np.searchsorted(before, keys & np.uint64((1 << (8 * k)) - 1))]
            self.cost.append(np.where(n > 0, seen, escape[of] + shorter).astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            self.gram.append(Lookup(keys))
            self.context.append(Lookup(contexts))
            before = keys

    def byte_bits(self, raw: np.ndarray, first: int, last: int, place: np.ndarray) -> np.ndarray:
        """Cost of each byte at first..last-1 in each language; place: its position in its own text."""
        key = grams(raw, first, last, self.order)
        out = np.zeros((last - first, len(self.langs)), np.float32)
        left = np.arange(last - first)
        for k in range(self.order, -1, -1):
            now = left[place[left] >= k] if k else left
            mine = key[now] & np.uint64((1 << (8 * (k + 1))) - 1)
            row = self.gram[k].find(mine)
            hit = row >= 0
            out[now[hit]] += self.cost[k][row[hit]]
            missed = now[~hit]
            if len(missed):
                row = self.context[k].find(mine[~hit] >> np.uint64(8))
                known = row >= 0
                out[missed[known]] += self.escape[k][row[known]]
                if k == 0:
                    out[missed] += 8.0
            left = np.concatenate([missed, left[place[left] < k]]) if k else missed
        return out

    def bits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text in each language; memory is bounded by BLOCK however long a text is."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        for a, b in blocks(at, BLOCK):
            for first in range(int(at[a]), int(at[b]), BLOCK):
                last = min(first + BLOCK, int(at[b]))
                inside = np.clip(at[a : b + 1], first, last)
                sizes = np.diff(inside)
                place = np.arange(first, last) - np.repeat(at[a:b], sizes)
                cost = self.byte_bits(raw, first, last, place)
                full = np.flatnonzero(sizes)
                out[a + full] += np.add.reduceat(cost, inside[full] - first, axis=0, dtype=np.float64)
        return out

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its posterior under equal priors."""
        bits = self.bits(raw, at)
        best = bits.argmin(axis=1)
        with np.errstate(under="ignore"):
            score = 1.0 / np.exp2(np.maximum(-1000.0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
        return [self.langs[i] for i in best], score


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES, part_chars: int = PART_CHARS, max_parts: int = MAX_PARTS) -> Model:
    """Learn from a bounded sample of rows with a ``lang``; rows that are held out are not used.

    Texts are taken in parts of ``part_chars`` code points, so a long text counts like many short ones and none is left
    out for its length; contexts do not go over the border of a part.  Parts are chosen by a hash of ``doc_id`` and their
    place, about ``sample_bytes`` a language (less where all languages together would have over ``total_bytes``), and
    ``max_parts`` in all.  If there are more, the languages with the most parts lose theirs first: all get equally
    many or, where a sample has fewer, the whole sample.  Rows with a null or empty text or a null ``lang`` teach nothing;
    a null ``doc_id`` counts as not held out."""
    known = docs.where(F.col("lang").isNotNull() & (F.char_length("text") > 0) & ~F.coalesce(held_out(), F.lit(False))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["size"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    texts: dict[str, list[bytes]] = {}
    if sizes:
        each, limit = min(sample_bytes, total_bytes / len(sizes)), F.lit(0)
        for lang, size in sizes.items():
            limit = F.when(F.col("lang") == lang, int(min(1.0, each / size) * (1 << 30))).otherwise(limit)
        pick = "pmod(xxhash64(doc_id, b, 'lang'), 1073741824)"
        parts = f"transform(filter(sequence(0, cast((char_length(text) - 1) div {part_chars} as int)), b -> {pick} < limit), b -> named_struct('pick', {pick}, 'part', substring(text, b * {part_chars} + 1, {part_chars})))"
        chosen = known.withColumn("limit", limit).select("lang", F.explode(F.expr(parts)).alias("x")).select("lang", "x.*")
        place = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "part"))
        for r in chosen.withColumn("place", place).where(F.col("place") <= max_parts).orderBy("place", "pick", "lang").limit(max_parts).select("lang", "part").collect():
            texts.setdefault(r["lang"], []).append(r["part"].encode())
    return Model(texts, order)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``keep`` (all, if None) of ``docs``; reads ``text`` only.

    ``und`` with score 0 where text is null, empty or without a letter, and everywhere if no language was learned.
    Repeated rows get equal results, ties go to the first language in order.  A very long text is scored whole, block by
    block, its contexts going over the blocks' borders.  Input columns named lang_pred or score are replaced; all others,
    however named, pass through.
    """
    docs = without(docs, *ADDED)
    keep = docs.columns if keep is None else keep
    own, has = free_names(docs, "__text", "__letter")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(own), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias(has))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            if m.langs and batch.num_rows:
                lang, score = m.predict(*text_buffer(batch.column(batch.num_columns - 2)))
            else:
                lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                letter = np.zeros(batch.num_rows, bool)
            lang = [x if y else "und" for x, y in zip(lang, letter, strict=True)]
            columns = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0))], names=[*keep, *ADDED])

    schema = rows.drop(own, has).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
