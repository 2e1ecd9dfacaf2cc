"""The queries themselves, and every stage of the pipeline, against brute force over the smallest tables."""

import collections
import hashlib
import math
import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_table_ops import plain_classes
from test_text_ops import plain_dedup, plain_secrets, plain_sketch
from tokenizers import Tokenizer

from seqmatch.llm import langid, mixing, packing, quality, secrets
from seqmatch.llm.common import BATCH_BYTES, table, text_buffer
from seqmatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect())


def collected(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_query(spark, documents):
    out = collected(spark, "op2_language_id")
    model = langid.train(table(spark, SF, "documents"))
    assert set(out) == {d[0] for d in documents}
    for i, text, _, _ in documents:
        (lang,), (score,) = model.predict(*text_buffer(pa.array([text or ""])))
        letters = any(c.isalpha() for c in text or "")
        assert out[i].held_out == held(i) and out[i].lang_pred == (lang if letters else "und")
        assert math.isclose(out[i].score, score if letters else 0.0, rel_tol=1e-4, abs_tol=1e-9)
    marked = [d for d in documents if d[2] and held(d[0]) and out[d[0]].lang_pred != "und"]
    assert np.mean([out[d[0]].lang_pred == d[2] for d in marked]) > 0.9


def plain_score(model, text):
    """Forward and backward sums over the lines' labels as numbers, straight from the definition."""
    x, _, _ = quality.line_features(*text_buffer(pa.array([text], pa.binary())))
    u, t = ((x - model.mean) / model.scale) @ model.w, np.exp(model.t)
    psi = np.stack([np.ones(len(u)), np.exp(np.clip(u, -300, 300))], axis=1)
    ahead, back = [psi[0] / psi[0].sum()], [np.ones(2)]
    for i in range(1, len(u)):
        a = psi[i] * (ahead[-1] @ t)
        ahead.append(a / a.sum())
    for i in range(len(u) - 1, 0, -1):
        b = t @ (psi[i] * back[0])
        back.insert(0, b / b.sum())
    good = np.array([a[1] * b[1] / (a @ b) for a, b in zip(ahead, back, strict=True)])
    weight = np.array([len(y) + 1 for y in text.split(b"\n")])
    mean = min(max((good * weight).sum() / weight.sum(), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.curve[0] * math.log(mean / (1 - mean)) + model.curve[1])))


def test_quality_query(spark, documents):
    out = collected(spark, "op3_quality")
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    for i, text, _, _ in documents:
        want = plain_score(model, (text or "").encode())
        assert out[i].held_out == held(i) and math.isclose(out[i].score, want, rel_tol=1e-6, abs_tol=1e-9) and out[i].predicted == (out[i].score >= 0.3)
    marks = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.quality is not None and held(r.doc_id)}
    assert np.mean([out[i].predicted == y for i, y in marks.items() if i in out]) > 0.9


def test_media_query(spark, documents):
    out = collected(spark, "op5_media")
    for i, text, _, _ in documents:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        a = np.frombuffer(payload, np.uint8)
        assert r.feature.split(";")[0] == f"576x{len(a) // 576}" and [int(x) for x in r.feature.split(";")[3].split(",")] == np.bincount(a >> 5, minlength=8).tolist()
    by_text = collections.defaultdict(set)
    for i, text, _, _ in documents:
        by_text[text or ""].add((out[i].media_sha256, out[i].media_bytes, out[i].feature))
    assert all(len(x) == 1 for x in by_text.values())


def check_packing(rows, out):
    """Pieces by the whole text's ids, places without gaps, no sequence too long; how many sequences there are."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = collections.Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048 and sum(3 * n > 2048 for _, n in items) <= 2
    plan = packing.Plan(collections.Counter(r.length for r in out))
    assert len(bins) == plan.bins <= 1.02 * sum(r.length for r in out) / 2048 + 1
    return len(bins)


def test_packing_query(spark, documents):
    check_packing([d[:2] for d in documents], QUERIES["op6_packing"](spark, SF).collect())


def test_secrets_query(spark, documents):
    out = collected(spark, "op8_secrets")
    extra = {r.name: re.compile(r.pattern, re.ASCII) for r in secrets.RULES if not r.base}
    for i, text, _, _ in documents:
        base = plain_secrets(text or "")
        kinds = collections.Counter(x.split(":")[0] for x in base)
        r = out[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds[k] for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        more = [f"{k}:{m.start(m.lastindex or 0)}:{m.end(m.lastindex or 0)}" for k, p in extra.items() for m in p.finditer(text or "")]
        assert sorted(r.spans.split(",")) == sorted([*base, *more] or [""])


def test_fingerprint_query(spark, documents):
    out = collected(spark, "op9_fingerprint")
    texts = [t or "" for _, t, _, _ in documents]
    following = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following, strict=True)]
    likeness = lambda x, y: len(x & y) / len(x | y)
    sketches = {t: s for t, s in zip(texts + edited, plain_sketch(spark, texts + edited), strict=True)}
    for (i, _, _, _), t, e, n in zip(documents, texts, edited, following, strict=True):
        r, (mine, a), (new, b), (_, c) = out[i], sketches[t], sketches[e], sketches[n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mine, new) and (r.removed, r.added) == (sorted(a - b), sorted(b - a))
        assert math.isclose(r.near_edited, likeness(a, b)) and math.isclose(r.near_next, likeness(a, c))


def test_join_query(spark, documents):
    out = collected(spark, "op10_ngram_join")
    rows = [d[:2] for d in documents]
    root, links = plain_classes(rows)
    for k, (i, _) in enumerate(rows):
        assert (out[i].class_id, out[i].n_links, out[i].keeper) == (rows[root[k]][0], links[k], root[k] == k)


def plain_copies(rows):
    """Poisson counts by adding up probabilities until they pass the number of each document."""
    sources = collections.Counter(r.source for r in rows)
    weight = {s: n**mixing.ALPHA for s, n in sources.items()}
    out = collections.Counter()
    for r in rows:
        rate = weight[r.source] / sum(weight.values()) * len(rows) / sources[r.source]
        u, k, mass = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        total = mass
        while total <= u:
            k += 1
            mass *= rate / k
            total += mass
        out[tuple(r)] += k
    return +out


def test_every_pipeline_stage(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    for i, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        docs = p.materialize(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        assert i + 1 == len(p.STAGES) or docs.columns == p.COLUMNS
        if name == "quality":
            model = quality.train(spark.createDataFrame(before, docs.schema), table(spark, SF, "labels"))
            want = [r for r in before if plain_score(model, (r.text or "").encode()) >= 0.3]
            assert sorted(after) == sorted(want) and len(want) < len(before)
        elif name == "line_dedup":
            plain = {x: (n, text) for x, _, n, text in plain_dedup([(r.doc_id, r.text) for r in before])}
            want = [(r.doc_id, plain[r.doc_id][1], r.lang, r.source, len(plain[r.doc_id][1]) if plain[r.doc_id][0] else r.n_chars) for r in before]
            assert sorted(tuple(r) for r in after) == sorted(want) and any(n for n, _ in plain.values())
        elif name == "ngram_join":
            rows = sorted(before)
            root, _ = plain_classes([(r.doc_id, r.text) for r in rows])
            assert sorted(after) == [r for k, r in enumerate(rows) if root[k] == k] and len(after) < len(before)
        elif name == "mixing":
            assert collections.Counter(tuple(r) for r in after) == plain_copies(before)
        else:
            check_packing([(r.doc_id, r.text) for r in before], after)
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "ngram_join", "mixing", "packing"]


def test_empty_tables(spark, tmp_path):
    """Every query gives no rows, and the right columns, for tables without rows."""
    for name in ("documents", "pages", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, f in QUERIES.items():
        out = f(spark, str(tmp_path))
        assert out.count() == 0 and out.columns == f(spark, SF).columns if name != "op10_ngram_join" else out.count() == 0, name


def test_ids_equal_those_of_whole_texts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    fast, other = packing.tokenizer(), packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.RandomState(9)
    alphabet = ["a", "don't", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "﻿", "᠎", "é", "é", "中", "٣", "12", "_", "-", ".", "'s", "'S", "<|endoftext|>", "🙂", "\x00", "ß", "²", "Ⅷ", "'", "'", "s", "LL", "(", "ж", "ΣΑ", "…"]
    texts = ["".join(alphabet[k] for k in rng.randint(0, len(alphabet), rng.randint(0, 12))) for _ in range(4000)]
    texts += ["x" * 5000, " " * 3000, "a b " * 2000, "word" * 40 + " end"] + [r.text or "" for r in table(spark, SF, "documents").select(F.col("text")).collect()]
    plain = [a for a in alphabet if all(c.isascii() or c in 'éßж' for c in a) and a not in ('\t', '\x0b', '\x1c', '\x00')]
    texts += ["".join(plain[k] for k in rng.randint(0, len(plain), rng.randint(0, 14))) for _ in range(6000)]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        assert list(fast(x)) == want and list(other(x)) == want, x[:80]


@pytest.mark.parametrize("name", ["quality", "ngram_join", "packing"])
def test_pipeline_bounds_batches_of_texts(spark, name):
    """Batches that a stage's Python gets in a session as it comes are small; with Spark's own bounds they had 50 MB here."""
    import corpus_pipeline as p

    own = spark.newSession()
    dict(p.STAGES)[name](own, table(own, SF, "documents"), SF)
    texts = own.range(10_000).select(F.repeat(F.lit("x"), 5_000).alias("text")).coalesce(1)
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"]) for b in batches), "size long, n long").collect()
    assert sum(r.n for r in sizes) == 10_000 and max(r.size for r in sizes) < BATCH_BYTES + 100_000


def test_pipeline_joins_alike_in_batches_of_one_row(spark):
    """Groups of rows that Python puts together again across batches; a session's own smaller bound is kept."""
    import corpus_pipeline as p

    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1")
    alone = p.without_near_copies(own, table(own, SF, "documents"), SF).collect()
    assert own._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == 1
    assert sorted(alone) == sorted(p.without_near_copies(spark, table(spark, SF, "documents"), SF).collect())


def test_packing_starts_no_workers_for_its_plan(spark):
    """The table of salts is a local one; made of Python objects it is an RDD, for which executors start workers of their own."""
    out = packing.place(spark.sql("SELECT id AS doc_id, 0 AS piece, 1 + id % 7 AS length FROM range(100)"))
    plan = out._jdf.queryExecution().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan and "ExistingRDD" not in plan
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and out.count() == 100
