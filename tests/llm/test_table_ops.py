"""Archives, media, packing, the n-gram join, components and the pipeline."""

import collections
import gzip
import hashlib
import io
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqmatch.llm import components, media, ngramjoin, packing, warc, webp, webpbatch
from seqmatch.llm.common import table
from seqmatch.llm.queries import ORACLE_SQL, QUERIES
from seqmatch.llm.webp import Options

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TEXTS = "doc_id long, text string"

# ---------------------------------------------------------------- archives

BIG = "<p>ü</p>" * 60_000


def pages(spark):
    rows = [(1, "http://a/\r\nx", BIG), (2, "http://b", BIG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 100), (3, "again", "y" * 200), (9, "u", "x" * 100), (None, "u", "x" * 100), (10, "u", "WARC/1.1\r\n\r\n" * 20)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    archives = warc.write(df, roll=2_000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    chunks = warc.read(archives, chunk=1000).cache()
    out = warc.summary(chunks).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        h = h or ""
        f = first.get(h)
        again = f is not None and i is not None and i > f
        want.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", f if again else None))
    assert sorted(map(repr, (tuple(r)[:5] for r in out))) == sorted(map(repr, want))
    one = chunks.where("page_id = 1").orderBy("chunk_no").collect()
    assert len(one) == -(-len(BIG.encode()) // 1000) and all(len(r.payload) <= 1000 for r in one)
    so_far = hashlib.sha256()
    for r in one:
        so_far.update(r.payload)
        assert r.digest_so_far == so_far.hexdigest()
    whole = {r.page_id: bytes(r.payload) for r in warc.assemble(chunks.where("page_id in (1, 7, 10)")).collect()}
    assert whole[1] == BIG.encode() and whole[10] == b"WARC/1.1\r\n\r\n" * 20
    chunks.unpersist()
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_reader_takes_other_writers_archives():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for raw in (gzip.compress(record * 2), gzip.compress(record) + gzip.compress(record)):
        got = list(warc.records(io.BytesIO(raw), chunk=2))
        assert [(r[1], r[2]) for r in got] == [(0, b"he"), (1, b"ll"), (2, b"o")] * 2
    with pytest.raises((EOFError, zlib.error)):
        list(warc.records(io.BytesIO(gzip.compress(record)[:-20])))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(gzip.compress(record[:-8]))))


# ---------------------------------------------------------------- images


def picture(rng, h, w, n):
    base = rng.randint(0, 256, (n, 4)).astype(np.uint32)
    colours = base[:, 0] << 24 | base[:, 1] << 16 | base[:, 2] << 8 | base[:, 3]
    return colours[np.minimum(rng.geometric(0.3, (h, w)) - 1, n - 1)].astype(np.uint32)


OPTIONS = [Options(), Options(subtract_green=True), Options(palette=True), Options(cross=(5, 250, 17)), Options(cache_bits=3), Options(cache_bits=10, copies="all"), Options(copies="runs", least=3), Options(copies="all"), Options(palette=True, predictor=2), Options(predictor=11, cross=(1, 2, 200), subtract_green=True, cache_bits=5, copies="all"), *[Options(predictor=m, shift=3) for m in range(14)]]


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 7, 2), (5, 3, 4), (9, 33, 16), (40, 37, 300)])
def test_images_round_trip(shape):
    rng = np.random.RandomState(sum(shape))
    a = picture(rng, *shape)
    tiles = (2, rng.randint(0, 3, (-(-shape[0] >> 2), -(-shape[1] >> 2))))
    for o in [*OPTIONS, Options(tiles=tiles, copies="all", cache_bits=4)]:
        assert (webp.decode(webp.encode(a, o)) == a).all(), o


def test_a_known_image():
    """One opaque black pixel: signature, sides of 1, no transform, cache or groups, five codes of one symbol."""
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)))
    for symbol, wide in ((0, 0), (0, 0), (0, 0), (255, 1), (0, 0)):
        bits += "1" + "0" + str(wide) + (format(symbol, "08b")[::-1] if wide else str(symbol))
    body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    file = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(file).tolist() == [[0xFF000000]]
    assert len(webp._NEAR) == 120 and webp._NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp._NEAR[-1] == (8, 7)


def test_broken_images():
    data = webp.encode((np.arange(576, dtype=np.uint32).reshape(1, 576) % 251) * np.uint32(0x010101))
    for bad in (data[:30], b"", data[:12] + b"VP8 " + data[16:], data[:20] + b"\0" + data[21:]):
        with pytest.raises(webp.FormatError):
            webp.decode(bad)


def test_code_lengths_are_limited_and_complete():
    counts = np.array([1 << min(i, 40) for i in range(60)])
    n = webp.code_lengths(counts)
    assert n.max() <= 15 and abs((0.5 ** n[n > 0]).sum() - 1) < 1e-12


def test_media_column(spark, monkeypatch):
    texts = ["a", "", None, "é" * 400, "x" * 576, "line\n" * 40_000, "a", "ÿ\x00\x7f" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS).withColumn("n_bytes", F.lit("clash"))
    out = media.round_trip(df, ["doc_id"], pixels=True).collect()
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert bytes(r.pixels) == payload and r.n_bytes == len(raw) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
    by = {r.doc_id: r for r in out}
    assert by[0].media_sha256 == by[6].media_sha256 and by[0].feature == by[6].feature
    assert media.round_trip(df.limit(0), ["doc_id"]).count() == 0
    long = os.urandom(576 * 1300)
    made = media.to_images([long, long[:576]], rows=600)
    assert [sum(1 for _ in media.images(m)) for m in made] == [3, 1]
    assert [x.tobytes() for x in media.from_images(made)] == [long, long[:576]]
    monkeypatch.setattr(media, "_MEMORY", 1)  # an image at a time
    assert media.to_images([long, long[:576]], rows=600) == made and media.from_images(made)[0].tobytes() == long


def payloads():
    """Samples for which each of the encoder's tools pays, and awkward ones; 576 bytes a row."""
    rng = np.random.RandomState(11)
    n = 192 * 12
    g = rng.randint(0, 256, n)
    walk = np.cumsum(rng.randint(-2, 3, (n, 3)), axis=0)
    down = np.cumsum(rng.randint(-2, 3, (40, 576)), axis=0) + rng.randint(0, 256, 576)
    words = rng.randint(0, 256, (30, 3))
    return {
        "plain": rng.randint(32, 127, 3 * n),
        "subtract_green": np.stack([g + rng.randint(0, 3, n), g, g + rng.randint(0, 3, n)], axis=1),
        "cross_colour": np.stack([((g ^ 128) - 128) // 2 + rng.randint(0, 3, n), g, rng.randint(0, 256, n)], axis=1),
        "predictor_left": walk,
        "predictor_top": down,
        "palette": words[rng.randint(0, 30, 192 * 2)],
        "copies": np.concatenate([x := rng.randint(0, 256, 576 * 3), x, x[3:], x[:3]]),
        "long copies": np.tile(rng.randint(0, 256, 576), 60),
        "blank": np.full(576, 255),
        "skewed": np.minimum(rng.geometric(0.5, 576 * 40), 255),
        "one row": rng.randint(0, 2, 576),
    }


def test_batches_of_images_use_each_tool():
    raw = {k: (np.asarray(v).ravel() & 255).astype(np.uint8) for k, v in payloads().items()}
    batch = webpbatch.Batch(list(raw.values()), 192)
    files = batch.encode()
    chosen = dict(zip(raw, (webpbatch.TOOLS[i] for i in batch.tool.tolist()), strict=True))
    assert {k: v for k, v in chosen.items() if k in webpbatch.TOOLS} == {k: k for k in webpbatch.TOOLS}
    cached = webpbatch.Batch([(words := np.random.RandomState(2).randint(0, 256, (300, 3)).astype(np.uint8))[np.random.RandomState(3).zipf(1.3, 192 * 20) % 300].ravel()], 192)
    more = cached.encode()
    assert cached.cached.all() and len(words) == 300
    # read in lockstep, one by one by the general decoder, and written alone: all the same
    for x, f, a, k in zip([*raw.values(), cached_raw(cached, more)], [*files, *more], webpbatch.decode([*files, *more]), [*raw, "cached"], strict=True):
        rgb = np.stack([a >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0)], axis=-1).astype(np.uint8)
        assert (a >> np.uint32(24) == 255).all() and (rgb.ravel() == x).all(), k
        assert (webp.decode(f) == a).all() and webpbatch.Batch([x], 192).encode() == [f], k


def cached_raw(batch, files):
    px = webp.decode(files[0])
    return np.stack([px >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0)], axis=-1).astype(np.uint8).ravel()


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 7, 2), (5, 3, 4), (9, 33, 16), (40, 37, 300)])
def test_batches_read_other_images(shape):
    rng = np.random.RandomState(sum(shape))
    pictures = [picture(rng, *shape) for _ in OPTIONS] + [picture(rng, shape[1], shape[0], 50)]
    tiles = (2, rng.randint(0, 3, (-(-shape[1] >> 2), -(-shape[0] >> 2))))
    files = [webp.encode(a, o) for a, o in zip(pictures, [*OPTIONS, Options(tiles=tiles)], strict=True)]
    for a, b, o in zip(pictures, webpbatch.decode(files), [*OPTIONS, None], strict=True):
        assert (a == b).all(), o


def test_batches_of_broken_images():
    good = webpbatch.Batch([np.random.RandomState(0).randint(32, 120, 576 * 3).astype(np.uint8)], 192).encode()[0]
    for bad in (good[:200], good[:60], good[:20] + b"\0" + good[21:], b""):
        with pytest.raises(webp.FormatError):
            webpbatch.decode([good, bad])


def test_lanes_have_huffman_codes():
    rng = np.random.RandomState(4)
    counts = np.maximum(0, rng.geometric(0.01, (40, 90)) - 60)
    counts[3] = [1 << min(i, 40) for i in range(90)]
    counts[4], counts[5] = 0, 0
    counts[5, 7] = 9
    got = webpbatch.huffman(counts, 15)
    for c, n in zip(counts, got, strict=True):
        plain = webp.code_lengths(c)
        assert (c * n).sum() == (c * plain).sum() or plain.max() == 15
        assert n.max() <= 15 and ((0.5 ** n[n > 0].astype(float)).sum() == 1 or (c > 0).sum() < 2)
        assert (webpbatch.codes(n[None])[0] == webp.Prefix(n.astype(np.int64)).codes()).all()


def test_stored_images_of_documents(spark):
    """The query's own images: which tools the estimate chooses for prose (no transform pays, the cache nearly always)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = media.store(docs, ["doc_id"]).collect()
    used = collections.Counter()
    for r in rows:
        for f in media.images(r.media):
            head = webpbatch._header(f)
            used["palette" if head is None else "cache" if head[4] else "no cache"] += 1
            used.update(["transformed"] * bool(head and head[5]))
    assert len(rows) == docs.count() and used["cache"] > 500 and used["no cache"] and used["palette"] + used["transformed"] < 20


# ---------------------------------------------------------------- packing


def test_plans_place_everything():
    r = random.Random(7)
    for _ in range(60):
        capacity = r.choice([10, 30, 2048])
        counts = collections.Counter(r.randint(1, capacity) for _ in range(r.randint(0, 400)))
        plan = packing.Plan(dict(counts), capacity)
        bins, ranks = collections.defaultdict(list), collections.defaultdict(set)
        for n, lo, hi, first, offset in plan.placed:
            for k in range(lo, hi):
                bins[first + k - lo].append((offset, n))
                ranks[n].add(k)
        assert all(ranks[n] == set(range(c)) for n, c in counts.items()) and set(bins) == set(range(plan.bins))
        for items in bins.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            assert at <= capacity and sum(3 * n > capacity for _, n in items) <= 2
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_packing(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "béta", "<|endoftext|>", "12", "\n"]) for _ in range(r.randrange(0, 400))) for _ in range(60)] + [None, "", "word " * 9000]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "x")]
    df = spark.createDataFrame(rows, TEXTS)
    out = packing.pack(df, with_ids=True).collect()
    encode = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((i, len(encode(t or "")) + 1) for i, t in rows)
    pieces = collections.Counter()
    for p in out:
        pieces[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        if p.doc_id is not None and p.doc_id > 0:
            assert list(p.ids) == [*encode(texts[p.doc_id] or ""), 0][p.start : p.start + p.length]
    for i in {x for x, _ in rows}:
        assert pieces[i] == sum(n * c for (d, n), c in want.items() if d == i)
    bins = collections.defaultdict(list)
    for p in out:
        bins[p.sequence_id].append((p.offset, p.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(df.limit(0)).count() == 0


# ---------------------------------------------------------------- n-gram join


def plain_classes(rows, threshold=0.8):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split("[ \t-\r]+", (t or "").translate(low)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], links


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.randrange(30, 120))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    texts = []
    for b in base:
        for k in range(6):
            t = list(b)
            for _ in range(k):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    near = list(base[0])
    for _ in range(30):
        near[r.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [" ".join([word() for _ in range(20)] + passage) for _ in range(20)]
    texts += [texts[0]] * 5 + [texts[0].upper(), None, "", " \n\t", "one two", "one  two", "One", "x " * 30_000]
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_join_equals_all_pairs(spark, monkeypatch):
    rows = corpus()
    root, links = plain_classes(rows)
    for small in (False, True):
        if small:  # every group of more than a few is dealt out as pairs of blocks
            monkeypatch.setattr(ngramjoin, "BUCKET_BLOCK", 4)
            monkeypatch.setattr(ngramjoin, "VERIFY_BLOCK", 3)
        df = spark.createDataFrame(rows, TEXTS).withColumn("t1", F.lit("clash"))
        out = {r.doc_id: r for r in ngramjoin.classes(df).collect()}
        assert len(out) == len(rows)
        for k, (i, _) in enumerate(rows):
            assert out[i].class_id == rows[root[k]][0] and out[i].n_links == links[k], (i, out[i])
            assert out[i].keeper == (root[k] == k)
    kept = {r.doc_id for r in ngramjoin.keep_one(df).collect()}
    assert kept == {rows[k][0] for k in range(len(rows)) if root[k] == k}


def test_join_edges(spark):
    assert ngramjoin.classes(spark.createDataFrame([], TEXTS)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "g h"), (4, "g h"), (4, "i j"), (None, None), (7, "")]
    out = ngramjoin.classes(spark.createDataFrame(rows, TEXTS)).collect()
    assert len(out) == 7 and sorted(r.n_links for r in out) == [0, 0, 0, 1, 1, 1, 1]
    assert ngramjoin.keep_one(spark.createDataFrame(rows, TEXTS)).count() == 5


def test_pruning_bound():
    least = ngramjoin.least_matches(0.8, 1e-6)
    assert least[0] == 0 and least == sorted(least) and 25 < least[60] < 40
    r = np.random.RandomState(0)
    kept = np.mean([all(np.cumsum(m)[n - 1] >= least[n] for n in range(12, 61, 12)) for m in (r.rand(20_000, 60) < 0.8)])
    assert kept > 0.9999
    assert 1 - (1 - 0.8**ngramjoin.ROWS) ** ngramjoin.BANDS > 1 - 1e-6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (300, 200)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_end_at_stars(spark, monkeypatch):
    written = []
    keep = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, what: written.append(what) or keep(df, what))
    stars = [(0, i) for i in range(1, 30)] + [(101, 100), (100, 102), (100, 102), (9, 9)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(30), 0), **dict.fromkeys((100, 101, 102), 100)} and len(written) == 2
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in range(60):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {x: root[x] for u, v in edges if u != v for x in (u, v)}


# ---------------------------------------------------------------- SQL


@needs_tables
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = lambda df: sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())
