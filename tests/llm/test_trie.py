"""The trie against a plain one of Python tuples: deep chains, hot first turns, equal conversations, nulls and ties, turnless conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import queries, trie


def plain(rows):
    own = {}
    for k, n, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "")):
        own.setdefault(k, []).append((r or "", t or ""))
    members, ends = {(): set()}, {}
    for k, turns in own.items():
        h, base = zlib.crc32(str(k).encode()) % 6, k - k % 100 if k >= 0 else k + -k % 100
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], set()).add(k)
        ends.setdefault(whole, []).append(k)
    children, below = {}, {}
    for w in members:
        if w:
            children.setdefault(w[:-1], []).append(w)
    for w in sorted(members, key=len, reverse=True):
        leaves, saved = (0 if w in children else 1), (len(members[w]) - 1) * len(w[-1][1]) if w else 0
        for c in children.get(w, []):
            leaves, saved = leaves + below[c][0], saved + below[c][1]
        below[w] = leaves, saved
    for w, m in members.items():
        text = ",".join(map(str, sorted(ends.get(w, []))))
        yield min(m), len(w), min(members[w[:-1]]) if w else None, len(m), len(children.get(w, [])), *below[w], hashlib.sha256(text.encode()).hexdigest()


FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rows_of(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    rows = []
    for k in [*range(60), *range(100, 130), *range(205, 230), -7, -250, 10**15]:
        n = r.choice([0, 1, 2, 3, 9, 12, 30])
        rows += [(k, r.choice([i, i, None]), r.choice(["user", "assistant", None]), r.choice(["", "a", "é", None, f"t{k % 7}"])) for i in range(n)]
    rows += [(k, i, "user", f"same {i}") for k in range(300, 420) for i in range(7)]
    rows += [(500, i, "user", f"deep {i % 3}") for i in range(700)] + [(k, i, "user", f"deep {i % 3}") for k in (501, 502) for i in range(650)]
    rows += [(None, 1, "user", "nobody's"), (3, 5, "user", "twice"), (3, 5, "user", "twice")]
    distinct = []  # ties of number and role follow hashes: keep one text for each
    seen = {}
    for row in rows:
        key = (row[0], row[1], row[2] or "")
        if seen.setdefault(key, row[3] or "") == (row[3] or ""):
            distinct.append(row)
    return distinct, spark.createDataFrame([(*x, 1, "mine") for x in distinct], "conv_id long, turn long, role string, text string, depth int, leader string").repartition(7)


def test_trie_of_odd_conversations(spark, odd):
    rows, df = odd
    want = sorted(plain(rows), key=str)
    assert rows_of(trie.trie(df)) == want
    assert max(w[1] for w in want) > trie.BAND**2
    assert trie.trie(df.where("false")).count() == 0 and trie.trie(df.where("conv_id IS NULL")).columns == FIELDS
    # conversations without a turn left end at the root
    few = df.where("conv_id IN (205, 206, 207, 208, 209)")
    assert rows_of(trie.trie(few)) == sorted(plain([x for x in rows if x[0] in range(205, 210)]), key=str)


def test_bands_of_any_height(spark, odd):
    rows, df = odd
    some = df.where("conv_id < 50")
    want = sorted(plain([x for x in rows if x[0] is not None and x[0] < 50]), key=str)
    run = trie.subtree_sums
    for band in (3,):
        trie.subtree_sums = lambda *a, band=band: run(*a, band=band)
        try:
            assert rows_of(trie.trie(some)) == want
        finally:
            trie.subtree_sums = run


def test_conversations_over_many_partitions(spark, odd):
    rows, df = odd
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        turns = trie.turns(df).groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("at").alias("d"), F.max("at").alias("m")).collect()
        assert all(t.n == t.d == t.m + 1 for t in turns)
        assert rows_of(trie.trie(df.where("conv_id >= 300"))) == sorted(plain([x for x in rows if x[0] is not None and x[0] >= 300]), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_trie(spark, "/root/testdata/sf0.01")) == sorted(plain(rows), key=str)


def test_sql_of_the_queries(spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    for name in ("op12_chat", "op13_trie"):
        got = queries.queries()[name](spark, "/root/testdata/sf0.01")
        rows = duck.execute(queries.oracle_sql()[name])
        names = [c[0] for c in rows.description]
        want = [dict(zip(names, r)) for r in rows.fetchall()]
        assert sorted((str([r[c] for c in sorted(got.columns)]) for r in got.collect())) == sorted(str([r[c] for c in sorted(r)]) for r in want), name
