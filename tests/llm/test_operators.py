"""Each operator against a plain version of its contract, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import components, decontaminate, html, language, licenses, mixing, quality, simhash, substrings, tokens, warc
from lattica.llm.common import buffers, written
from lattica.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed, words=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(300, 1)
    many = [base, base + " tail of its own", "start of its own " + base, prose(60, 2), "", None, "   \n ", "one", "two words", "É à ü ñ", prose(4000, 3, 5000)]
    many += [prose(120, 9)] * 3 + [base.replace("w1 ", "W1 ", 1)]
    return [(i if i != 7 else None, t, "en", None if i % 3 == 0 else f"s{i % 3}") for i, t in enumerate(many)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*t, 1, 2.0) for t in texts], "doc_id long, text string, lang string, source string, fp int, size double")


def empty(df):
    return df.where("false")


def test_packing_is_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 1000):
        for top in (2, 1000, 49408, 2**32, 2**63):
            ids = rng.integers(0, top, n, dtype=np.uint64)
            if n > 10:
                ids[n // 2] = 2**64 - 1
            words, first = tokens.pack(ids)
            assert (tokens.unpack(words, first, n) == ids).all()


def test_encoder_is_the_tokenizer(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    e = tokens.Encoder(tokenizer_path())
    many = ["", None, "a\x1cb <|endoftext|>x y", "IİΣ'sΣ é éx", "日本 語　x\n\n'll I'll", "x" * 40 + " " + "y" * 17, prose(500, 4), "<|startoftext|", " a b"]
    for _ in range(3):
        ids, counts = e.encode(pa.array(many))
        want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in many], add_special_tokens=False)]
        assert [list(map(int, p)) for p in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_tokens_round_trip(spark, docs, texts):
    got = tokens.token_table(spark, docs, tokenizer_path()).collect()
    tok = tokens.Encoder(tokenizer_path()).tokenizer
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((t[0] for t in texts), key=lambda k: (k is not None, k or 0))
    by = {r.doc_id: r for r in got}
    for k, t, *_ in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (by[k].n_tokens, by[k].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert tokens.token_table(spark, empty(docs), tokenizer_path()).count() == 0


def test_warc(spark):
    page = "<p>" + "same " * 40
    rows = [(5, "http://a/b c", page), (3, None, page), (9, "http://x", page), (1, "u", "short"), (2, "u", "short"), (4, "v", None), (6, "w", "é" * 60), (None, "n", page + "x")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    first = {}
    for k, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and k is not None:
            first[data] = min(first.get(data, k), k)
    for k, _, h in rows:
        data = (h or "").encode()
        again = data in first and first[data] != k
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[k].record_type, got[k].refers_to) == (("revisit", first[data]) if again else ("response", None))
    index = warc.write_archives(pages, warc.shared_dir(spark, "w"))
    some = {r.page_id: r.html for r in warc.read_records(index.where("page_id IN (3, 6)"), payload=True).collect()}
    assert some == {3: page, 6: "é" * 60}
    assert warc.round_trip(spark, empty(pages)).count() == 0


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body class=home><header><a href=/>Site</a></header><div id="cookie-notice">We use cookies, all of them.</div>
    <div class="wrap"><div class="sidebar"><p>A side note, long enough to count as one paragraph.</p></div><div class="content"><h1>Head &lt;1&gt;</h1>
    <p>First, with commas, and <b>bo</b>ld text of some length.</p><form><p>Sign up, please, for letters of ours.</p></form><ul><li>x<li>y</ul><p>Last&nbsp;one.</div>
    <div id="comments"><p>Great, article, I liked it a lot, really.</p></div></div><script>var t="</p>";</script><footer>F</footer>"""
    assert html.main_text(page) == "Head <1> First, with commas, and bold text of some length. x y Last one."
    for p, want in (("", ""), (None, ""), ("plain &amp; simple", "plain & simple"), ("<p>hi <!-- never ends", "hi"), ('<nav><a href="x">l</a></nav>', ""), ("<a b='", "<a b='"), ("<" * 5000, "<" * 5000)):
        assert html.main_text(p) == want
    deep = "<div>" * 3000 + "<p>" + "deep text, " * 20
    assert html.main_text(deep).startswith("deep text,")
    rows = spark.createDataFrame([(1, page, "old"), (2, None, "old")], "page_id long, html string, text string")
    assert [(r.n_chars, bool(r.text)) for r in html.extract(rows).orderBy("page_id").collect()] == [(len(html.main_text(page)), True), (0, False)]


def repeats(t):
    w, n = WORD.findall(t or ""), quality.WINDOW
    c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})


def test_quality_counts(spark, docs, texts):
    more = [t[1] for t in texts] + ["a a a a a a a a a a\n\n \nx\nx\nx \n#*|", "\n", "é\n\né", "b c d e f g h i j " * 3]
    found = quality.count(*buffers(pa.array(more)))
    for i, t in enumerate(more):
        lines, seen, dup = (t or "").split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(WORD.findall(t or "")), sum(map(len, WORD.findall(t or ""))), len(re.findall(r"[#*$%&|<>]", t or "")), dup, repeats(t))
        assert tuple(int(found[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (3, 0, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    rows = quality.judge(docs, rules).collect()
    assert len(rows) == len(texts) and all(not r.kept for r in rows if r.base_failed)
    assert quality.judge(empty(docs), rules).count() == 0


def test_decision_list_learns_and_is_its_expression(spark):
    rng = np.random.default_rng(3)
    names = list(quality.ratios())
    x = rng.random((3000, len(names)))
    good = ~((x[:, 2] > 0.7) | ((x[:, 4] > 0.5) & (x[:, 6] < 0.3)))
    rules = quality.learn(x, good, names)
    assert (rules.predict(x, names) == good).mean() > 0.97
    assert quality.learn(x[:0], good[:0], names).rules == () and quality.learn(x, np.ones(3000, bool), names).default
    counts = [[int(v) for v in rng.integers(0, 50, len(quality.COUNTS))] for _ in range(200)]
    df = spark.createDataFrame(counts, ", ".join(f"{c} long" for c in quality.COUNTS)).select("*", *[c.alias(k) for k, c in quality.ratios().items()], rules.column().alias("verdict")).toPandas()
    assert (rules.predict(df[names].to_numpy(float), names) == df.verdict).all()


def plain_fingerprint(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(fps, ids):
    fps, lab = np.array(fps, np.uint64), np.array(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(fps))])
        if (new == lab).all():
            return lab
        lab = new


def test_simhash_classes(docs, texts):
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.classes(docs).collect()}
    named = [(k, plain_fingerprint(t)) for k, t, *_ in texts if k is not None]
    want = dict(zip((k for k, _ in named), plain_components([f for _, f in named], [k for k, _ in named])))
    assert {k: v for k, v in got.items() if k is not None} == {k: (f, want[k]) for k, f in named}
    assert simhash.classes(empty(docs)).count() == 0


def test_anchors_miss_no_link(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flip = lambda n, top: np.uint64(1) << rng.integers(0, top, n).astype(np.uint64)
    x = np.unique(np.concatenate([base, *[base[:8] ^ flip(8, 64) ^ flip(8, 64) ^ flip(8, 64) for _ in range(20)], *[base[:1] ^ flip(1, 14) ^ flip(1, 14) for _ in range(500)]]))
    want = plain_components(x, np.arange(len(x)))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for full, square in ((32768, 8192), (40, 16)):
        monkeypatch.setattr(simhash, "FULL", full)
        monkeypatch.setattr(simhash, "SQUARE", square)
        root = {r.node: r.root for r in components.components(simhash.fingerprint_links(fps)).collect()}
        got = [root.get(int(v), int(v)) for v in x.view(np.int64)]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(50, 50), (61, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)} | {60: 60, 61: 60}


def plain_removal(rows, n=35):
    words = [WORD.findall(t or "") for t in rows]
    c = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("few", [2000, 1])
def test_substrings(docs, texts, few, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_RUNS", few)
    r = random.Random(5)
    passage, other = prose(50, 20), prose(40, 21)
    more = [(100 + i, f"{prose(r.randrange(30), 30 + i)} {passage if i % 2 else other} {prose(r.randrange(60), 60 + i)} {other if i % 3 == 0 else ''}") for i in range(12)]
    more += [(200, passage + " " + passage), (201, " ".join(["x"] * 80)), (202, prose(35, 77)), (203, prose(35, 77))]
    table = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    rows = [t[:2] for t in texts] + more
    want = dict(zip((k for k, _ in rows), plain_removal([t for _, t in rows])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(table).collect()}
    assert got == want
    assert substrings.remove_repeats(empty(table)).count() == 0


def test_repeated_rows_lose_everything(spark):
    rows = spark.createDataFrame([(1, prose(50, 1))] * 2 + [(2, prose(50, 2))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(rows).collect()) == [(1, 50), (1, 50), (2, 0)]


@pytest.mark.parametrize("array_rows, stretch", [(50_000, 1 << 15), (50_000, 7), (0, 1 << 15), (0, 7)])
def test_decontamination(spark, array_rows, stretch, monkeypatch):
    monkeypatch.setattr(decontaminate, "ARRAY_ROWS", array_rows)
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    r = random.Random(3)
    v = ["a", "b", "c", "é"]
    items = [(i, " ".join(r.choice(v) for _ in range(n))) for i, n in enumerate([1, 3, 8, 12, 13, 14, 30, 0, 7, 9])] + [(98, "a b C!"), (99, None), (None, " ".join(r.choice(v) for _ in range(20)))]
    docs = [(i, " ".join(r.choice(v[1:]) for _ in range(r.randrange(40))) + " " + (r.choice(items)[1] or "")) for i in range(12)] + [(50, None), (51, ""), (None, "x, " + items[6][1].upper().replace("É", "é"))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    want = {}
    for k, t in docs:
        w, hit, ids = low(t), set(), set()
        for item, text in items:
            x = low(text)
            n = min(13, len(x))
            for s in range(len(x) - n + 1) if x else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[s : s + n]:
                        hit.update(range(at, at + n))
                        ids |= {str(item)} if item is not None else set()
        want[k] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.contamination(d, b).collect()}
    assert got == want
    assert {r.n_hit for r in decontaminate.contamination(d, empty(b)).collect()} == {0}
    assert decontaminate.contamination(empty(d), b).count() == 0


def test_decontamination_scans_documents_once(spark, monkeypatch):
    scans = []
    monkeypatch.setattr(decontaminate, "written", lambda df, name: scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("scanned#")) or written(df, name))
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, scanned string").withColumnRenamed("scanned", "text")
    docs = written(docs.withColumnRenamed("text", "scanned"), "docs").withColumnRenamed("scanned", "text")
    bench = spark.createDataFrame([(i, " ".join(prose(n, n).split())) for i, n in enumerate([1, 2, 5, 8, 12, 13, 40])], "item_id long, text string")
    out = decontaminate.contamination(docs, bench)
    assert sum("Relation" in line and "scanned" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 0
    assert sum(n > 0 for n in scans) == 1 and out.count() == 2


def test_language(spark):
    rng = np.random.default_rng(0)
    net = language.Network.fresh(["a", "b", "c"], hidden=4, kind=np.float64)
    x, y = rng.integers(0, 5, (3, 6)).astype(np.uint8), np.array([0, 2, 1])
    _, grads = language.gradients(net, x, y)
    for p, g in zip(net.parameters(), grads):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            old = p[at]
            p[at] = old + 1e-5
            up = language.gradients(net, x, y)[0]
            p[at] = old - 1e-5
            down = language.gradients(net, x, y)[0]
            p[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("score"))
    more = spark.createDataFrame([(None, None, None, 1), (7001, "", "en", 1), (7002, "123 !! \n", "en", 1), (7003, "x", None, 1)], docs.schema)
    net = language.fit(docs)
    rows = language.predict(docs.unionByName(more), net).withColumn("held_out", language.held_out()).toPandas()
    held = rows[rows.held_out & rows.lang.notna() & (rows.text != "")]
    assert (held.lang_pred == held.lang).mean() > 0.95 and rows.score.between(0, 1).all()
    assert set(rows[rows.doc_id.isin([7001, 7002])].lang_pred) == {"und"} and rows[rows.doc_id.isna()].lang_pred.iloc[0] == "und"
    none = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.predict(more, none).collect()} == {"und"}


def test_reading_in_stretches_is_the_network():
    net = language.Network.fresh(["a", "b"], hidden=5)
    text = bytes(range(32, 100))
    raw, offsets = buffers(pa.array([text.decode(), "", "zz"]))
    x = np.frombuffer(text, np.uint8)[None]
    h = [np.zeros(5), np.zeros(5)]
    states = [[], []]
    for d, order in ((0, range(len(text))), (1, range(len(text) - 1, -1, -1))):
        for t in order:
            a, g = net.table[d][x[0, t]], h[d] @ net.state[d].T
            z, r = 1 / (1 + np.exp(-(a[:5] + g[:5]))), 1 / (1 + np.exp(-(a[5:10] + g[5:10])))
            n = np.tanh(a[10:] + r * g[10:])
            h[d] = n + z * (h[d] - n)
            states[d].append(h[d])
    both = np.concatenate([states[0], states[1][::-1]], 1)
    p = np.exp(both @ net.out + net.bias)
    want = (p / p.sum(1, keepdims=True)).mean(0)
    got = language.Reader(net).probabilities(raw, offsets)
    assert np.allclose(got[0], want, atol=1e-4) and (got[1] == 0).all() and got[2].sum() == pytest.approx(1, abs=1e-4)


def test_licenses(spark):
    mit = "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software. The above copyright notice and this permission notice shall be\n// included in all copies or substantial portions. Bye."
    rows = [(1, "x.\nReleased under the MIT License."), (2, mit), (3, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (4, None), (5, ""), (6, "no such word"), (7, "Copyright 2020 Me. All rights reserved."), (8, "Licensed under CC BY-NC 4.0.\n\nSPDX-License-Identifier: GPL-3.0"), (9, "under the frobnicate licence")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "proprietary", 8: "GPL-3.0,CC-BY-NC", 9: "unknown"}


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, prose(r.randrange(1, 60), i), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["tiny"] * 9 + [None] * 40)]
    rows += [(5000, None, "big"), (5001, "", "none"), (None, "no id", "mid")] + [(6000, "the same row", "mid")] * 3
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, source string, size int")
    out = mixing.plan(docs, shards=8).toPandas()
    assert len(out) == len(rows) and (out.copies <= 2).all() and sorted(map(repr, out.doc_id)) == sorted(repr(float("nan") if x[0] is None else float(x[0])) for x in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * size[s] if s in capped else left * weight[s] / total for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    out["source"] = out["source"].where(out["source"].notna(), None)
    for s in names:
        part = out[out.source.isna() if s is None else out.source == s]
        assert part.target.iloc[0] == pytest.approx(target[s]) and part.source_size.iloc[0] == size[s]
        assert abs((part.copies * part["size"]).sum() - target[s]) <= 60
    again = mixing.plan(docs.repartition(7), shards=8).toPandas()
    key = lambda d: sorted((repr(a), b, tuple(c)) for a, b, c in zip(d.doc_id, d.copies, d.shards))
    assert key(out) == key(again)
    mixed = mixing.mix(docs, shards=8)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(x for i, c in zip(out.doc_id.where(out.doc_id.notna(), None), out.copies) for x in [None if i is None or i != i else int(i)] * int(c))
    assert mixing.plan(empty(docs)).count() == 0


def test_hypergeometric_draws(spark):
    u = "(shiftrightunsigned(xxhash64(id), 11) + 0.5D) / 9007199254740992D"
    for n, k, d in ((40, 15, 20), (1000, 300, 500), (10, 10, 3), (7, 0, 3), (100000, 30000, 50000)):
        got = np.array([r.x for r in spark.range(2000).select(F.expr(mixing.hypergeometric(f"{n}L", f"{k}L", f"{d}L", u)).alias("x")).collect()])
        mean, var = d * k / n, d * k / n * (1 - k / n) * (n - d) / max(n - 1, 1)
        assert (got >= max(0, d + k - n)).all() and (got <= min(d, k)).all()
        assert abs(got.mean() - mean) < 5 * (var / 2000) ** 0.5 + 1e-9 and (var == 0 or abs(got.var() / var - 1) < 0.25)
    leaves = mixing.split(spark.createDataFrame([([100, 37, 0, 1],)], "quotas array<bigint>"), 3, 5).collect()
    assert len(leaves) == 8 and [sum(x) for x in zip(*(r.quotas for r in leaves))] == [100, 37, 0, 1]
    sums = [sum(r.quotas) for r in leaves]
    assert max(sums) - min(sums) <= 1


def test_licenses_without_hint_words(spark):
    want = {"Released under GPLv3": "GPL-3.0", "uses LGPL v2.1": "LGPL-2.1", "AGPL-3": "AGPL-3.0", "CC0": "CC0-1.0", "BSD 3-Clause": "BSD-3-Clause", "attribution-sharealike": "CC-BY-SA", "it is in the public\ndomain": "public-domain", "# all rights\n# reserved": "proprietary", "nothing": ""}
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert [r.licenses for r in licenses.scan(rows).orderBy("doc_id").collect()] == list(want.values())


def test_licenses_in_their_usual_wording(spark):
    gpl = "This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required, software distributed under the License is distributed on an "AS IS" BASIS.'
    tags = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "CC0-1.0": "CC0-1.0", "GPL-2.0-only": "GPL-2.0", "AGPL-3.0": "AGPL-3.0"}
    want = {f"// SPDX-License-Identifier: {tag}\n": name for tag, name in tags.items()} | {gpl.format(2): "GPL-2.0", gpl.format(3): "GPL-3.0", apache: "Apache-2.0"}
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = licenses.scan(rows).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == list(want.values())
    assert got[-1].sentence_ids == "Apache2Ref,ApacheUse,ApacheCopy,ApacheAsIs"


def test_main_text_of_wrapped_pages():
    body = " ".join(f"<p>Paragraph {i} of the article, with commas, and enough words to count as text.</p>" for i in range(6))
    want = " ".join(f"Paragraph {i} of the article, with commas, and enough words to count as text." for i in range(6))
    for page in ("<svg-icon></svg-icon>{}", "<title-bar></title-bar>{}", "<svg viewBox='0 0 1 1'/>{}", "<form action=x><div>{}</div></form>", "<article class='post has-comments'>{}</article>", "<div id=content class=share-enabled>{}</div>"):
        assert html.main_text("<html><body>" + page.format(body) + "</body></html>") == want, page
    page = f"<html><body><div>{body}</div><div class=comments><p>A reader says something, with commas, and some words.</p></div><form><p>Search, subscribe, and other words of a form here.</p></form></body></html>"
    assert html.main_text(page) == want
