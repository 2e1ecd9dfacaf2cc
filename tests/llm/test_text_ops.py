"""Language, quality, line dedup, mixing, secrets and fingerprints against brute force, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqmatch.llm import iblt, langid, linededup, mixing, quality, secrets
from seqmatch.llm.common import blocks, text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and that with this from house water".split(), "de": "der die und nicht auch wasser haus schön über".split(), "fr": "le la les et où être maison garçon eau".split()}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def make(n=150, seed=0):
    r = random.Random(seed)
    return [(i, prose(r, lang, r.randrange(3, 60)), lang, f"s{i % 3}", 0) for i in range(n) for lang in [r.choice(list(WORDS))]]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- language


def plain_bits(model_texts, order, text):
    """Code length by the definition, byte by byte."""
    counts = collections.defaultdict(collections.Counter)
    for t in model_texts:
        for i, c in enumerate(t):
            for k in range(min(i, order) + 1):
                counts[t[i - k : i]][c] += 1
    total = 0.0
    for i, c in enumerate(text):
        k = min(i, order)
        while True:
            seen = counts.get(text[i - k : i] if k else b"")
            if seen:
                n, q = sum(seen.values()), len(seen)
                if c in seen:
                    total -= math.log2(seen[c] / (n + q))
                    break
                total -= math.log2(q / (n + q))
            if k == 0:
                total += 8
                break
            k -= 1
    return total


def test_code_lengths_follow_the_definition():
    texts = {"en": [b"the house of the water", b"and that"], "fr": ["où être là".encode(), b"la maison"]}
    model = langid.Model(texts, 3)
    cases = [b"the maison", b"", "über".encode(), b"x", b"the the the", bytes(range(256))]
    bits = model.bits(*text_buffer(pa.array(cases, pa.binary())))
    for row, case in zip(bits, cases, strict=True):
        assert np.allclose(row, [plain_bits(texts[x], 3, case) for x in model.langs], rtol=1e-4)


def test_long_texts_in_blocks(monkeypatch):
    model = langid.Model({"en": [b"the house of the water"]}, 4)
    case = pa.array([b"the house " * 50, b"", b"of the water" * 30], pa.binary())
    whole = model.bits(*text_buffer(case))
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.allclose(whole, model.bits(*text_buffer(case)), rtol=1e-5)


def test_language_rows(spark):
    rows = make() + [(900, None, "en", None, None), (901, "", None, None, None), (902, "123 !?", "de", None, None), (903, "the of and " * 5000, None, None, None), (None, "wasser und haus", "de", None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    model = langid.train(docs)
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(out) == len(rows) and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert out[903].lang_pred == "en" and 0 <= out[903].score <= 1
    right = [out[r[0]].lang_pred == r[2] for r in rows[:150]]
    assert np.mean(right) > 0.95
    none = langid.identify(empty(spark), langid.train(empty(spark)))
    assert none.count() == 0
    assert langid.identify(docs, langid.Model({})).where("lang_pred <> 'und'").count() == 0


def test_held_out_rows_are_not_learned(spark):
    rows = make()
    changed = [(i, "zzz" if zlib.crc32(str(i).encode()) % 5 == 0 else t, x, s, n) for i, t, x, s, n in rows]
    a, b = (langid.train(spark.createDataFrame(r, DOCS)) for r in (rows, changed))
    assert all(np.array_equal(x, y) for x, y in zip(a.cost, b.cost, strict=True))


def test_rare_languages_keep_their_rows(spark):
    rows = [(i, "der die und nicht auch", "de", "s", 0) for i in range(3000)] + [(9000 + i, f"the of and {i}", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    learned = docs.where(~langid.held_out()).groupBy("lang").count().collect()
    model = langid.train(docs, sample_bytes=20000, max_parts=100)
    assert model.langs == ["de", "en"] and min(r["count"] for r in learned) < 50
    whole = langid.Model({"en": [t.encode() for (i, t, lang, _, _) in rows if lang == "en" and zlib.crc32(str(i).encode()) % 5]})
    assert set(model.gram[4].keys.tolist()) >= set(whole.gram[4].keys.tolist())


def test_languages_of_long_texts_only_are_learned(spark):
    r = random.Random(1)
    rows = [(i, prose(r, "en", 20), "en", "s", 0) for i in range(60)] + [(100 + i, prose(r, "de", 9000), "de", "s", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"__text": F.lit(1), "__LETTER": F.lit(2)})
    model = langid.train(docs, sample_bytes=60_000)
    assert model.langs == ["de", "en"]
    out = langid.identify(docs, model)
    assert set(docs.columns) < set(out.columns) and out.where("lang_pred <> lang").count() == 0
    whole = langid.train(docs, sample_bytes=10_000_000)
    learned = [t for i, t, lang, _, _ in rows if lang == "de" and zlib.crc32(str(i).encode()) % 5]
    parts = [t[a : a + langid.PART_CHARS].encode() for t in learned for a in range(0, len(t), langid.PART_CHARS)]
    plain = langid.Model({"de": parts, "en": [t.encode() for i, t, lang, _, _ in rows if lang == "en" and zlib.crc32(str(i).encode()) % 5]})
    assert len(parts) > len(learned) and all(np.array_equal(x, y) for x, y in zip(whole.cost, plain.cost, strict=True))


def test_held_out_marks(spark):
    rows = [(i, None, None, None, None) for i in [*range(200), -7, 2**62, None]]
    out = spark.createDataFrame(rows, DOCS).select("doc_id", langid.held_out().alias("h")).collect()
    assert all(x.h == (None if x.doc_id is None else zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)


# ---------------------------------------------------------------- quality


def test_chain_messages_equal_enumeration():
    r = np.random.RandomState(0)
    per = np.array([3, 1, 4])
    u, t = r.randn(8), r.randn(2, 2)
    ahead, back = quality.Chain(per).messages(u, t)
    got, at = quality._sigmoid(ahead + back), 0
    for n in per:
        weight = {}
        for labels in np.ndindex(*[2] * n):
            weight[labels] = math.exp(sum(u[at + i] * y for i, y in enumerate(labels)) + sum(t[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        for i in range(n):
            assert math.isclose(got[at + i], sum(w for y, w in weight.items() if y[i]) / sum(weight.values()), rel_tol=1e-9)
        at += n


def enumerated(u, t):
    """Weight of each labelling of a chain."""
    return {y: math.exp(sum(v * z for v, z in zip(u, y, strict=True)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))) for y in np.ndindex(*[2] * len(u))}


def test_score_equals_enumeration():
    model, r = quality.Model(), np.random.RandomState(3)
    model.w, model.t, model.curve = r.randn(quality.N_FEATURES), r.randn(2, 2), np.array([1.7, -0.4])
    model.mean, model.scale = r.rand(quality.N_FEATURES), 0.5 + r.rand(quality.N_FEATURES)
    texts = [b"One line.", b"", b"a a a\n\nBAD!! BAD!! | 12\n\xc3\xa9t\xc3\xa9 averyverylongword averyverylongwore\na a a\nend", b"x\nx\ny"]
    got = model.score(*text_buffer(pa.array(texts, pa.binary())))
    for text, score in zip(texts, got, strict=True):
        x, size, _ = quality.line_features(*text_buffer(pa.array([text], pa.binary())))
        lines = text.split(b"\n")
        assert size.tolist() == [len(y) for y in lines]
        weight = enumerated(((x - model.mean) / model.scale) @ model.w, model.t)
        good = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(len(lines))]
        mean = sum(g * (len(y) + 1) for g, y in zip(good, lines, strict=True)) / sum(len(y) + 1 for y in lines)
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        assert math.isclose(score, 1 / (1 + math.exp(-(1.7 * math.log(mean / (1 - mean)) - 0.4))), rel_tol=1e-9)


def test_gradient_equals_differences():
    r = np.random.RandomState(1)
    per, x, y = np.array([3, 1, 2]), r.randn(6, 4), np.array([1, 0, 1, 1, 0, 0.0])
    params = r.randn(8) * 0.5

    def loss(p):
        total, at = 0.0, 0
        for n in per:
            weight = enumerated(x[at : at + n] @ p[:4], p[4:].reshape(2, 2))
            total -= math.log(weight[tuple(int(v) for v in y[at : at + n])] / sum(weight.values()))
            at += n
        return total

    got = quality.gradient(x, y, quality.Chain(per), per, params)
    for i in range(8):
        step = np.eye(8)[i] * 1e-6
        assert math.isclose(got[i], (loss(params + step) - loss(params - step)) / 2e-6, rel_tol=1e-5, abs_tol=1e-7)


def test_repeated_words_are_compared_whole():
    x, _, _ = quality.line_features(*text_buffer(pa.array([b"internationally internationals", b"internationally internationally"], pa.binary())))
    assert x[:, quality.N_CLASSES + 1].tolist() == [0.0, 0.5]


def test_features_do_not_depend_on_line_blocks(monkeypatch):
    model = quality.Model().fit([b"good words here\nand more", b"BAD!! BAD!!\nWORSE!!"] * 20, np.array([1, 0] * 20))
    texts = pa.array([b"\n".join(b"line %d of it" % (i % 7) for i in range(50)), b"", b"\n" * 9, b"a\nb"], pa.binary())
    whole = model.score(*text_buffer(texts))
    monkeypatch.setattr(quality, "LINES", 4)
    assert np.allclose(whole, model.score(*text_buffer(texts)), atol=1e-12)


def test_quality_learns_from_long_texts_and_rare_labels(spark):
    r = random.Random(6)
    text = lambda bad, n: "\n".join(prose(r, "en", 12).upper().replace(" ", "!! ") if bad else prose(r, "en", 12) for _ in range(n))
    docs = [(i, text(i % 2 == 0, 1500), "en", "s", 0) for i in range(24)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(i, 1) for i in range(1000, 3000)], "doc_id long, quality int")
    model = quality.train(spark.createDataFrame(docs, DOCS), marks, sample_rows=16, part_chars=4000)
    out = quality.score(spark.createDataFrame(docs, DOCS).withColumn("__text", F.lit("kept")), model).collect()
    assert all(x.predicted == x.doc_id % 2 and x["__text"] == "kept" for x in out)
    docs = [(i, text(i < 12, 3), "en", "s", 0) for i in range(600)]
    marks = spark.createDataFrame([(i, int(i >= 12)) for i in range(600)], "doc_id long, quality int")
    few = quality.score(spark.createDataFrame(docs, DOCS), quality.train(spark.createDataFrame(docs, DOCS), marks, sample_rows=40), keep=["doc_id"]).collect()
    assert np.mean([x.predicted == int(x.doc_id >= 12) for x in few]) > 0.99


def test_quality_learns_and_keeps_rows(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = "\n".join(prose(r, "en", 12).upper().replace(" ", "!! ") if bad else prose(r, "en", 12) for _ in range(3))
        docs.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad)))
    docs += [(900, None, None, None, None), (901, "", None, None, None), (902, "\n" * 5000, None, None, None), (5, docs[5][1], "en", "s", 0), (None, "plain words", None, None, None)]
    docs = spark.createDataFrame(docs, DOCS).withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), (7, labels[7][1])], "doc_id long, quality int")
    model = quality.train(docs, marks)
    out = quality.score(docs, model, keep=["doc_id"]).collect()
    assert len(out) == 405 and all(0 <= x.score <= 1 for x in out)
    truth = dict(labels)
    assert np.mean([x.predicted == truth[x.doc_id] for x in out if x.doc_id in truth]) > 0.97
    kept = quality.score(docs, model, only_good=True)
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in out if x.predicted} and "text" in kept.columns
    assert quality.score(empty(spark), quality.Model()).count() == 0


def test_score_does_not_depend_on_the_batch():
    model = quality.Model().fit([b"good words here\nand more", b"BAD!! BAD!!\nWORSE!!"] * 20, np.array([1, 0] * 20))
    texts = [b"some text\nwith lines", b"", b"OH!! NO!!" * 300000, b"x"]
    together = model.score(*text_buffer(pa.array(texts, pa.binary())))
    alone = [model.score(*text_buffer(pa.array([t], pa.binary())))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-12)


# ---------------------------------------------------------------- lines


def plain_dedup(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(linededup.UPPER, linededup.UPPER.lower()))
    count, keeper = collections.Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] += 1
            if i is not None:
                keeper[k] = max(i, keeper.get(k, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and count[key(x)] >= 5 and i != keeper.get(key(x)))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    hot, é = "This line is shared by many documents, all over.", "É" * 45
    rows = [(i, f"own {i} {'x' * 40}\n{'  ' if i % 2 else ''}{hot.upper() if i % 3 else hot}\t\nshort\nshort") for i in range(8)]
    rows += [(20 + i, f"{é}\n{é}") for i in range(6)] + [(30, None), (31, ""), (32, "\n\n"), (33, hot), (33, hot), (None, hot), (40, "a" * 300000 + "\n" + hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("keep", F.lit(1))
    out = linededup.dedup_lines(docs)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=repr)
    assert got == plain_dedup(rows) and "keep" in out.columns
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nobody = spark.createDataFrame([(None, hot)] * 6, "doc_id long, text string")
    assert linededup.dedup_lines(nobody).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_dedup_counts_documents(spark):
    few, many = "A line of two documents in five rows, not of five documents.", "A line of five documents, which the first four of them lose."
    rows = [(1, few)] * 3 + [(2, few)] * 2 + [(i, many) for i in range(10, 15)] + [(None, few)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_dropped} == {10, 11, 12, 13} and len(out) == len(rows)


def test_line_dedup_passes_clashing_columns_and_many_lost_lines(spark):
    lines = [f"line {j} of a passage that all of the documents share" for j in range(400)]
    rows = [(i, "\n".join(["first", *lines[: 200 + i], "last"]), *"abcdefgh") for i in range(6)]
    names = ["__doc", "__t1", "__T2", "__u1", "__u2", "__lost", "__lines", "__kept"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == plain_dedup([r[:2] for r in rows]) and {tuple(r[c] for c in names) for r in out.collect()} == {tuple("abcdefgh")}


# ---------------------------------------------------------------- mixing


def test_mixing_counts(spark):
    rows = [(i, f"t{i}", "en", ["a", "b", None][min(2, i // 600)], 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("clash"))
    out = mixing.replicate(docs, {"a": 1.0, "b": 2.0}, total=4000)
    got = collections.Counter((r.source, r.doc_id) for r in out.collect())
    rate = {"a": 4000 / 3 / 600, "b": 4000 * 2 / 3 / 400}
    for i, _, _, s, _ in rows:
        if s is None:
            assert not got[s, i]
            continue
        u, k, mass = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate[s])
        total = mass
        while total <= u:
            k += 1
            mass *= rate[s] / k
            total += mass
        assert got[s, i] == k
    assert abs(sum(v for (s, _), v in got.items() if s == "b") / (4000 * 2 / 3) - 1) < 0.1


def test_mixing_edges(spark):
    assert mixing.replicate(empty(spark)).count() == 0
    rows = [(None, None, None, None, None)] * 3 + [(1, "x", "en", "s", 1)] * 2
    a = mixing.replicate(spark.createDataFrame(rows, DOCS), total=40.0)
    assert a.where("copy >= n_copies").count() == 0
    same = [r.n_copies for r in a.where("doc_id = 1").collect()]
    assert len(set(same)) <= 1
    big = mixing.replicate(spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS), total=2000.0).count()
    assert 1700 < big < 2300


def test_mixing_large_rates(spark):
    rates = spark.createDataFrame([("a", 3.5), ("b", 700.0), ("c", 2e6), ("d", 0.0)], "source string, rate double")
    got = {r.source: r for r in mixing.distributions(rates).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].least == 0 and len(got["c"].cdf) < 40000
    for s, rate in (("a", 3.5), ("b", 700.0), ("c", 2e6)):
        p, k = np.array(got[s].cdf), got[s].least + np.arange(len(got[s].cdf))
        exact = np.cumsum(np.exp(k * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in k.tolist()])))
        assert abs(p - exact).max() < 1e-8 and math.isclose(p[-1], 1.0) and p[0] < 1e-10 + math.exp(-min(rate, 700))
    docs = spark.createDataFrame([(1, "x", "en", "s", 1), (2, "y", "en", "s", 1)], DOCS).withColumns({"__cdf": F.lit(1), "__least": F.lit(2), "__u": F.lit(3), "__source": F.lit(4)})
    out = mixing.replicate(docs, total=200_000.0)
    assert 198_000 < out.count() < 202_000 and set(docs.columns) < set(out.columns)


def test_mixing_order_is_random(spark):
    docs = spark.createDataFrame([(i, str(i), "en", "s", 1) for i in range(2000)], DOCS)
    ids = [r.doc_id for r in mixing.replicate(docs).select("doc_id").collect()]
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.1


# ---------------------------------------------------------------- secrets

KEYWORDS = "password|passwd|secret|token|api_?key"
SPELLED = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", KEYWORDS)
ASSIGN = re.compile(rf"""({SPELLED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [("assign", m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return [f"{k}:{a}:{b}" for k, (a, b) in sorted(out, key=lambda x: (x[1][0], order.index(x[0])))]


CASES = ["é PassWord = 'abc' token: \"12345678\"", "AKIA" + "A" * 12 + " AKIA123 akia" + "B" * 16, "0123456789abcdef" * 2 + "g" + "f" * 31, "api_key=apikey=secretsecret", "tokentoken:abcdefgh.ijk=", "ſecret=longsecretvalue", None, "", "token = " + "x" * 200000, "secret:\nabcdefghij", "TOKEN=aaaaaaa TOKEN=aaaaaaaa"]


def test_secrets(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)) + [(0, CASES[0]), (None, CASES[1])], "doc_id long, text string").withColumn("found", F.lit("clash"))
    out = secrets.scan(docs).withColumn("spans", F.expr(secrets.printed("found"))).collect()
    assert len(out) == len(CASES) + 2
    for r in out:
        text = CASES[1] if r.doc_id is None else CASES[r.doc_id]
        assert r.spans == ",".join(plain_secrets(text or "")), text and text[:60]
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_web_tokens_in_linear_time():
    rule = next(r for r in secrets.RULES if r.name == "web_token")
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    r = random.Random(5)
    parts = ["eyJ", "eyJabcdefgh", "abcdefgh", ".", ".", " ", "é", "_", "x"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert list(rule.spans(text)) == [m.span() for m in plain.finditer(text)], text
        assert not plain.search(text) or re.search(rule.screen, text)
    began = time.process_time()
    assert not list(rule.spans("eyJ" * 400_000))
    assert time.process_time() - began < 5


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, CASES[0]), (2, "clean")], "doc_id long, text string")
    second = spark.createDataFrame([(1, CASES[0]), (3, CASES[0]), (4, CASES[2])], "doc_id long, text string")
    ledger = secrets.Ledger(spark)
    secrets.scan(first, ledger=ledger)
    seen, found = ledger.scanned().count(), ledger.findings().count()
    out = secrets.scan(second, ledger=ledger)
    rules = len(secrets.RULES)
    assert seen == 2 * rules and ledger.scanned().count() == 3 * rules
    assert ledger.findings().count() == found + len(plain_secrets(CASES[2]))
    assert {r.doc_id: len(r.found) for r in out.collect()} == {1: len(plain_secrets(CASES[0])), 3: len(plain_secrets(CASES[0])), 4: len(plain_secrets(CASES[2]))}
    secrets.scan(second, ledger=ledger)
    assert ledger.scanned().count() == 3 * rules
    newer = [secrets.Rule("hex", "2", "[0-9a-f]{8,}", "[0-9a-f]{8}"), *[x for x in secrets.RULES if x.name != "hex"]]
    again = secrets.scan(second, newer, ledger)
    assert ledger.scanned().count() == 3 * rules + 2 and again.where("doc_id = 4").first().found[0]["rule"] == "hex"


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(spark):
    r = random.Random(2)
    texts = ["\n".join(prose(r, "en", r.randrange(1, 9)) for _ in range(r.randrange(0, 30))) for _ in range(25)] + [None, "", "é" * 7, "\n".join(str(i) for i in range(3000)), "a. B c. Z"]
    ids = list(range(0, 10 * len(texts), 10))
    rows = list(zip(ids, texts, strict=True)) + [(None, "null id")]
    out = {x.doc_id: x for x in iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = [(None, "null id"), *rows[:-1]]
    parts = lambda x: set(re.split(iblt.PARAGRAPH.replace("\\n", "\n"), x))
    assert len(out) == len(rows)
    for (i, a), (_, b) in zip(order, [*order[1:], order[0]], strict=True):
        a, b = a or "", b or ""
        q = len(a) // 4
        e = a[: len(a) - q] + b[:q]
        likeness = lambda x, y: len(x & y) / len(x | y)
        assert out[i].n_chars == len(a) and out[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert math.isclose(out[i].near_edited, likeness(parts(a), parts(e))) and math.isclose(out[i].near_next, likeness(parts(a), parts(b)))
    assert iblt.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = iblt.fingerprints(spark.createDataFrame([(5, "x. Yes\nz")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    same = iblt.fingerprints(spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (2, "a\nb"), (3, "c")], "doc_id long, text string")).collect()
    assert len(same) == 4 and len({x.fingerprint for x in same}) == 2


def test_paragraphs_do_not_depend_on_the_alphabet(spark):
    sentences = ["Zwei Wege.", "no capital.", "7 of 9.", "Über uns.", "Жили были.", "\u4e00\u4e8c.", "Apples."]
    text = " ".join(sentences)
    rows = [(1, text), (2, " ".join([*sentences[:-1], "Others."])), (3, "x")]
    out = {x.doc_id: x for x in iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    q = len(text) // 4
    edited = set(re.split(r"(?<=[.]) ", text[: len(text) - q] + rows[1][1][:q]))
    assert out[1].fingerprint.split(";")[0] == "7" and math.isclose(out[1].near_next, 6 / 8)
    assert math.isclose(out[1].near_edited, len(edited & set(sentences)) / len(edited | set(sentences))) and out[1].near_edited > 0


def plain_sketch(spark, texts):
    """The cells by the definition: 48, in three groups of 16, one of each group for a digest."""
    keys = sorted({p for t in texts for p in re.split(r"\n|(?<=[.]) ", t)})
    rows = spark.createDataFrame([(k,) for k in keys], "p string").select("p", F.xxhash64("p").alias("k")).select("p", "k", F.xxhash64("k").alias("h"), *[F.xxhash64(F.lit(g), F.lit(0), "k").alias(f"g{g}") for g in range(3)]).collect()
    of = {r.p: r for r in rows}
    for t in texts:
        cells = {}
        for p in set(re.split(r"\n|(?<=[.]) ", t)):
            for g in range(3):
                cell = (of[p][f"g{g}"] & 15) * 3 + g
                c, k, h = cells.get(cell, (0, 0, 0))
                cells[cell] = c + 1, k ^ of[p].k, h ^ of[p].h
        word = lambda x: format(x & (2**64 - 1), "X")
        yield f"{len(set(re.split(chr(10) + '|(?<=[.]) ', t)))};" + ",".join(f"{cell}.{c}.{word(k)}.{word(h)}" for cell, (c, k, h) in sorted(cells.items())), {of[p].k for p in re.split(r"\n|(?<=[.]) ", t)}


def test_fingerprints_and_recovered_digests_equal_brute_force(spark):
    r = random.Random(8)
    texts = ["\n".join(prose(r, "en", r.randrange(1, 9)) for _ in range(n)) for n in (0, 1, 5, 20, 90, 300, 2)] + ["", "same\nsame\n\n"]
    out = sorted(iblt.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    for x, (mine, a), (new, e) in zip(out, plain_sketch(spark, texts), plain_sketch(spark, edited), strict=True):
        assert x.fingerprint == mine and x.edited_fingerprint == new
        assert x.removed == sorted(a - e) and x.added == sorted(e - a)


def test_sketches_retry_larger(spark):
    sets = spark.createDataFrame([(1, list(range(500)), list(range(250, 900)), [1]), (2, [7], [7], [8]), (3, [], [], []), (4, list(range(30)), list(range(40, 80)), list(range(25)))], "id long, a array<long>, b array<long>, c array<long>")
    want = {(1, 0): (list(range(250)), list(range(500, 900))), (1, 1): ([0, *range(2, 500)], []), (2, 1): ([7], [8]), (4, 0): (list(range(30)), list(range(40, 80))), (4, 1): (list(range(25, 30)), [])}
    # expecting nothing to differ, all pairs start with the fingerprint's cells; expecting all, most start with more
    for share in (0.0, 0.5, 1.0):
        rows = iblt.differences(sets, [("a", "b", share), ("a", "c", share)]).collect()
        out = {(x.id, x.pair): (x.mine, x.other) for x in rows if x.mine or x.other}
        assert out == want and all((x.n_mine, x.n_other) == (len(x.mine), len(x.other)) for x in rows)
    rows = iblt.differences(sets, [("a", "b", 0.0), ("a", "c", 0.5)], recover=[1]).collect()
    assert {(x.id, x.pair): (x.n_mine, x.n_other) for x in rows if x.n_mine or x.n_other} == {k: (len(a), len(b)) for k, (a, b) in want.items()}
    assert all(not x.mine and not x.other for x in rows if x.pair == 0)


def test_blocks():
    at = np.array([0, 3, 3, 10, 11])
    assert blocks(at, 4) == [(0, 2), (2, 3), (3, 4)] and blocks(np.array([0]), 4) == []


@pytest.mark.parametrize("name", ["op2_language_id", "op3_quality", "op4_line_dedup", "op7_mixing", "op8_secrets", "op9_fingerprint"])
def test_queries_are_registered(name):
    from seqmatch.llm.queries import QUERIES

    assert name in QUERIES
