"""The pipeline's stages on their own inputs and the whole against plain versions of their decisions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from lattica.llm import common, sketch

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").lower().split()
    return set(zip(*[w[i:] for i in range(5)])) or {tuple(w)}


def test_majorities_and_hashes_of_spans():
    r = np.random.default_rng(1)
    count = np.array([0, 1, 700, 2, 0, 255, 256])
    h = r.integers(0, 2**63, count.sum(), dtype=np.uint64) * np.uint64(2)
    got, at = common.majorities(h, count), 0
    for n, word in zip(count, got):
        own = h[at : at + n]
        assert int(word) == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > n)
        at += n
    raw = r.integers(0, 256, 20_000).astype(np.uint8)
    begin = r.integers(0, 19_000, 2000)
    end = begin + np.where(r.random(2000) < 0.8, r.integers(0, 70, 2000), r.integers(0, 900, 2000))
    assert [int(x) for x in common.xxh64(raw, begin, end)] == [xxhash.xxh64_intdigest(raw[i:j].tobytes(), 42) for i, j in zip(begin, end)]


def test_near_duplicates(spark):
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    bases = [fresh(250) for _ in range(12)]
    rows, at = [], 0
    for b in bases:
        for edits in (0, 0, 1, 2, 3, 60):
            w = b[:]
            for i in r.sample(range(250), edits):
                w[i] = f"new{at}_{i}"
            rows.append((at, " ".join(w), "en", "s", 1))
            at += 1
    crowd_base = fresh(250)
    for i in range(40):
        w = crowd_base[:]
        w[r.randrange(250)] = f"c{i}"
        rows.append((at + i, " ".join(w), "en", "s", 1))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "no id", "en", "s", 0), (902, "short", "en", None, 0), (903, "Short", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = {k: shingles(t) for k, t, *_ in rows if k is not None}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {k for k in sets if find(k) == k} | {None}
    kept = sketch.keep_one(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == want
    assert sketch.keep_one(docs.where("false")).count() == 0


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        ids = Counter(r.doc_id for r in after.select("doc_id").collect())
        before = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert set(ids) <= set(before)
        assert max(ids.values()) <= (2 if name == "mixture" else 1)
        docs = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in last)
    assert 0 < len({r.doc_id for r in whole}) <= n


def test_pairs_at_the_required_similarity(spark):
    """Texts with 80 common shingles and 19, 20 or 21 others: 0.81 and 0.8 are linked, 0.79 is not, for each of many pairs."""
    rows, want = [], set()
    for i in range(120):
        others = 19 + i % 3
        common = [f"p{i}w{k}" for k in range(84)]
        for side, n in ((0, others // 2), (1, others - others // 2)):
            rows.append((2 * i + side, " ".join(common + [f"p{i}s{side}t{k}" for k in range(n)])))
        want |= {2 * i} if others <= 20 else {2 * i, 2 * i + 1}
    kept = sketch.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == want


def test_crowd_of_almost_similar_texts(spark):
    """240 texts of one template at a similarity of 0.78 that all meet; each has one twin at 0.81, which is found in whatever part it is."""
    template, rows = [f"t{k}" for k in range(304)], []
    for i in range(120):
        for side in (0, 1):
            rows.append((i + 120 * side, " ".join(template + [f"p{i}k{k}" for k in range(6)] + [f"p{i}s{side}k{k}" for k in range(36)])))
    sets = [shingles(t) for _, t in sorted(rows)]
    assert all((len(sets[0] & x) >= 0.8 * len(sets[0] | x)) == (k in (0, 120)) for k, x in enumerate(sets))
    key, count = sketch.shingle_sets(pa.array([t for _, t in sorted(rows)]))
    ends, (band, sign) = np.cumsum(count), sketch.bands(sketch.minima(key, count))
    nodes = spark.createDataFrame([(i, int(count[i]), bytearray(band[i].tobytes()), bytearray(sign[i].tobytes())) for i in range(240)], "id long, n long, bands binary, signature binary")
    links = sketch.similar_links(nodes, spark.createDataFrame(rows, "id long, text string"), square=20_000)
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} == {(i, i + 120) for i in range(120)}


def test_forest_of_random_links():
    r = np.random.default_rng(5)
    for n in (2, 5, 40, 300):
        for _ in range(40):
            a, b = r.integers(0, n, n), r.integers(0, n, n)
            low = list(range(n))
            for i, j in zip(a, b):
                x, y = low[i], low[j]
                low = [min(x, y) if z in (x, y) else z for z in low]
            got = dict(zip(*(x.tolist() for x in common.forest(a, b))))
            assert got == {i: low[i] for i in {*a.tolist(), *b.tolist()} if low[i] != i}


def test_forests_are_those_of_all_pairs():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 14, r.integers(0, 16))).astype(np.uint64) for _ in range(150)]
    a, b = sketch.similar(np.concatenate(sets), np.array([len(s) for s in sets]), 0.8)
    root, want = list(range(150)), list(range(150))
    for label, pairs in ((root, zip(a, b)), (want, ((i, j) for i in range(150) for j in range(i) if len(sets[i]) and len(sets[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))))):
        for i, j in pairs:
            x, y = label[i], label[j]
            label[:] = [min(x, y) if z in (x, y) else z for z in label]
    assert root == want and len(set(root)) < 150
