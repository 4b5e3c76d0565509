"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, for every operator and stage; and that each
result comes through its method."""

import hashlib
import random
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import common, components, decontaminate, html, language, licenses, mixing, quality, simhash, sketch, substrings, tokens, warc
from lattica.llm.queries import tokenizer_path

from test_operators import plain_components, plain_fingerprint, plain_removal, prose, WORD

#: Names that operators use inside.
CLASHING = ["_hash", "_rows", "anchor", "bad_id", "component_id", "copies", "copy", "digest", "f", "first", "fp", "h", "hash", "id", "key", "kept", "LANG_PRED", "n", "names", "node", "places", "root", "row", "rows", "score", "shards", "size", "start", "t", "target", "text_hash", "th", "turn", "words"]
LONG = prose(150_000, 8, 9000)
ODD = [(1, prose(60, 1)), (1, prose(60, 1)), (1, "another text of the same id"), (None, None), (None, "no id, but words"), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG + " one more"), (6, "È x \x00 y"), (7, None), (8, prose(60, 1).upper())]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, ("en", None, "de")[i % 3], ("a", "b", None)[i % 3], 1) for i, (k, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING]).repartition(3)


def ids(df, key="doc_id"):
    return Counter(r[0] for r in df.select(key).collect())


EVERY = Counter(k for k, _ in ODD)


def test_language_of_odd_texts(spark, odd):
    net = language.train(["das ist ein Haus und noch ein Haus".encode(), b"this is the house and this is that"], ["de", "en"], steps=80)
    docs = odd.drop("score", "LANG_PRED")
    got = language.predict(docs, net)
    assert got.columns == [*docs.columns, "lang_pred", "score"] and ids(got) == EVERY
    by = {}
    for r in got.collect():
        by.setdefault((r.doc_id, r.text), set()).add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by.values())
    for k, t in ODD:
        ((pred, score),) = by[k, t]
        assert (pred == "und" and score == 0) if not any(c.isalpha() for c in t or "") else pred in ("de", "en") and 0.5 <= score <= 1
    assert language.predict(docs.where("false"), net).count() == 0
    assert language.fit(docs.where("false")).languages == []


def test_language_sample_is_bounded_and_the_same(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda s, names, **k: seen.append((sorted(s), Counter(names))) or language.Network.fresh(sorted(set(names))))
    rows = [(i, f"text number {i} " + "y" * 300, "en" if i % 10 else "de") for i in range(4000)] + [(17, "copy", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(docs.repartition(7), snippets=100)
    language.fit(docs.repartition(2), snippets=100)
    assert seen[0] == seen[1] and all(70 <= seen[0][1][name] <= 100 for name in ("en", "de"))


def test_decontamination_with_a_very_long_item(spark, odd):
    item = prose(20_000, 31, 3000).split()
    docs = [(1, "x y " + " ".join(item[500:540]) + " z"), (2, " ".join(item[500:512])), (3, " ".join(item)), (3, " ".join(item)), (4, LONG)]
    got = sorted(tuple(r)[:4] for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item)), (10, None)], "item_id long, text string")).collect())
    assert got == [(1, 43, 40, 1), (2, 12, 0, 0), (3, 20_000, 20_000, 1), (3, 20_000, 20_000, 1), (4, 150_000, 0, 0)]


def test_bit_table_knows_every_mark(spark):
    values = [0, 1, 63, 64, 8589934591, 77, 12345678]
    bits, size = decontaminate._bit_table(spark.createDataFrame([(v,) for v in values], "hash long"), len(values))
    rows = spark.range(0, 4000).union(spark.createDataFrame([(v,) for v in values], "id long")).select("id", bits.alias("bits")).select("id", F.expr(f"shiftright(bits[cast(shiftright(pmod(id, {size}), 6) AS int)], cast(pmod(id, {size}) & 63 AS int)) & 1").alias("hit")).collect()
    assert all(r.hit for r in rows if r.id in values) and sum(r.hit for r in rows) < 200


def test_decontaminated_docs_keep_their_columns(spark, odd):
    bench = spark.createDataFrame([(1, "no id, but words"), (2, None), (3, "")], "item_id long, text string")
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and ids(kept) == EVERY - Counter([None])
    assert kept.where("_hash <> 'mine _hash' OR hash <> 'mine hash' OR row <> 'mine row'").count() == 0
    assert ids(decontaminate.clean(odd, bench.where("false"))) == EVERY and decontaminate.clean(odd.where("false"), bench).count() == 0


def test_tokens_of_odd_texts(spark, odd):
    folder = common.shared_dir(spark, "shards")
    manifest = tokens.write_ids(odd, folder, tokenizer_path())
    fs, root = common.filesystem(folder)
    with fs.open_output_stream(f"{root}/shard-0000000-999999.s8b") as lost:  # of an attempt that did not count
        lost.write(b"half a shard")
    got = sorted(tokens.read_ids(manifest).collect(), key=lambda r: r.start)
    tok = tokens.Encoder(tokenizer_path()).tokenizer
    want = Counter()
    for k, t in ODD:
        x = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[k, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id or 0 for r in got] == sorted(k or 0 for k, _ in ODD)


def test_substrings_of_odd_texts(spark, odd):
    want = Counter((k, *w) for (k, _), w in zip(ODD, plain_removal([t for _, t in ODD])))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(odd).collect()) == want


def plain_factors(runs, anchors, twice):
    out = []
    for i, x in enumerate(runs):
        at = 0
        while at < len(x):
            best = len(x) - at if twice[i] else 0
            for j, y in enumerate(runs):
                for q in range(len(y)):
                    k = 0
                    while anchors[i] == anchors[j] and (j, q) != (i, at) and at + k < len(x) and q + k < len(y) and x[at + k] == y[q + k]:
                        k += 1
                    best = max(best, k)
            if best:
                out.append((i, at, best))
            at += max(1, best)
    return out


def test_factors_are_greedy_and_longest():
    r = random.Random(0)
    for _ in range(200):
        anchors = sorted(r.randrange(2) for _ in range(r.randrange(1, 8)))
        runs = [[r.randrange(4) for _ in range(r.randrange(1, 9))] for _ in anchors]
        twice = [r.random() < 0.2 for _ in runs]
        got = substrings.parse(np.array(anchors, np.uint64), np.array(twice), np.array([len(x) for x in runs]), np.array([p for x in runs for p in x], np.uint64))
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(plain_factors(runs, anchors, twice))


def test_nothing_is_removed_without_factors(spark, monkeypatch):
    docs = spark.createDataFrame([(1, prose(80, 1)), (2, prose(80, 1)), (3, prose(40, 2) + " " + prose(50, 1))], "doc_id long, text string")
    assert {r.n_removed for r in substrings.remove_repeats(docs).collect()} != {0}
    monkeypatch.setattr(substrings, "parse", lambda *a: (np.empty(0, np.int64),) * 3)
    assert {r.n_removed for r in substrings.remove_repeats(docs).collect()} == {0}


def test_classes_of_odd_texts(spark, odd):
    got = simhash.classes(odd).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter((k, plain_fingerprint(t)) for k, t in ODD)
    named = [(k, plain_fingerprint(t)) for k, t in ODD if k is not None]
    want = plain_components([f for _, f in named], [k for k, _ in named])
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(k, int(w)) for (k, _), w in zip(named, want)}


def test_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "CONTRACTED", 3)
    monkeypatch.setattr(components, "LAST", 0)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(900, i) for i in range(200, 230)] + [(50, 50), (61, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)} | {i: 200 for i in [900, *range(200, 230)]} | {60: 60, 61: 60}


def test_near_duplicates_of_odd_texts(spark, odd):
    kept = sketch.keep_one(odd)
    assert kept.columns == odd.columns
    # rows without an id stay, those of one id go or stay together; 5 is near 4, 8 has the words of 1, and 2, 3 and 7 have none
    assert ids(kept) == Counter({None: 2, 1: 3, 2: 1, 4: 1, 6: 1}) and sketch.keep_one(odd.where("false")).count() == 0


def test_licenses_of_odd_texts_and_in_sql(spark, odd):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
    more = [(20, mit), (20, mit), (21, "SPDX-License-Identifier:\tMIT\nx"), (22, "The License at\n\n http://x"), (23, LONG + " Released under GPLv3."), (24, "a; either version 3"), (25, "Released under the MIT License. All rights reserved.")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = licenses.scan(docs.withColumn("names", F.lit(1)).withColumn("found", F.lit(2)))
    assert ids(got) == EVERY + Counter(k for k, _ in more)
    by = {r.doc_id: r for r in got.collect()}
    assert by[20].sentence_ids == "MitGrant,MitNotice" and by[20].licenses == "MIT" and by[21].licenses == "MIT" and by[23].licenses == "GPL-3.0" and by[7].licenses == "" and by[25].licenses == "MIT,proprietary"
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(licenses.duckdb_sql()).fetchall()
    assert Counter(map(repr, want)) == Counter(repr(tuple(r)) for r in got.collect())
    assert licenses.scan(odd.where("false")).count() == 0


def test_no_license_lacks_all_words():
    """Every match of every pattern holds one of WORDS: in a stretch of plain letters, or in each branch of an alternative."""
    from re import _parser as parser

    def sure(parts):
        run = ""
        for kind, value in [*parts, (None, None)]:
            if str(kind) == "LITERAL":
                run += chr(value)
                continue
            if any(w in run for w in licenses.WORDS):
                return True
            run = ""
            if str(kind) == "BRANCH" and all(sure(b) for b in value[1]) or str(kind) == "SUBPATTERN" and sure(value[-1]) or str(kind) == "MAX_REPEAT" and value[0] and sure(value[2]):
                return True
        return False

    assert [name for name, pattern in licenses.MENTIONS if not sure(parser.parse(pattern))] == []
    assert [k for k in licenses.KNOWN if not any(w in k for w in licenses.WORDS)] == []


def test_every_mention_finds_its_license(spark):
    """For each rule of one sentence, the sentence in its usual wording or short form."""
    said = {"GPLv3": "GPL-3.0", "under the GPL-2": "GPL-2.0", "AGPL-3": "AGPL-3.0", "LGPL v2.1": "LGPL-2.1", "LGPLv3": "LGPL-3.0", "BSD 2-Clause": "BSD-2-Clause", "the modified BSD license": "BSD-3-Clause", "under a BSD-style license": "BSD", "under the ISC license": "ISC", "Mozilla Public License 2.0": "MPL-2.0", "Eclipse Public License - v 2.0": "EPL-2.0", "Boost Software License": "BSL-1.0", "under the zlib license": "Zlib", "Attribution-NonCommercial-ShareAlike 4.0": "CC-BY-NC-SA", "CC BY-NC-ND": "CC-BY-NC-ND", "Attribution-NoDerivs": "CC-BY-ND", "Creative Commons Attribution": "CC-BY", "CC0 1.0": "CC0-1.0"}
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(rows).collect()} == dict(enumerate(said.values()))
    known = spark.createDataFrame([(i, s) for i, s in enumerate(licenses.KNOWN)], "doc_id long, text string")
    assert [r.sentence_ids for r in licenses.scan(known).orderBy("doc_id").collect()] == list(licenses.KNOWN.values())


def test_mix_of_odd_texts(spark, odd):
    out = mixing.plan(odd, shards=4).collect()
    assert Counter(r.doc_id for r in out) == EVERY and all(len(r.shards) == len(r.places) == r.copies <= 2 for r in out)
    mixed = mixing.mix(odd, shards=4)
    assert mixed.columns == odd.columns and mixed.where("_hash <> 'mine _hash' OR row <> 'mine row' OR copies <> 'mine copies' OR text_hash <> 'mine text_hash'").count() == 0
    assert ids(mixed) == Counter([r.doc_id for r in out for _ in range(r.copies)])
    assert mixing.mix(odd.where("false")).count() == 0


def test_the_leaves_decide_what_is_taken(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(20, i), "ab"[i % 2]) for i in range(600)], "doc_id long, text string, source string")
    found, real = [], mixing.split

    def watched(quotas, levels, seed):
        found.append(real(quotas, levels, seed))
        return found[-1]

    monkeypatch.setattr(mixing, "split", watched)
    rows = mixing.plan(docs, shards=8).collect()
    of_source = {"a": 0, "b": 1}
    leaves = {(r.shard, i): q for r in found[0].collect() for i, q in enumerate(r.quotas)}
    taken = Counter((s, of_source[r.source]) for r in rows for s in r.shards)
    assert {k for k, q in leaves.items() if q} == set(taken) and sum(leaves.values()) > 0
    for shard in range(8):  # places permute the documents of a shard
        own = [(p, r.doc_id) for r in rows for s, p in zip(r.shards, r.places) if s == shard]
        assert len({p for p, _ in own}) == len(own) and (len(own) < 9 or [k for _, k in sorted(own)] != sorted(k for _, k in own))
    monkeypatch.setattr(mixing, "split", lambda quotas, levels, seed: real(quotas, levels, seed).withColumn("quotas", F.transform("quotas", lambda q: q * 0)))
    assert {r.copies for r in mixing.plan(docs, shards=8).collect()} == {0}


def test_quality_of_odd_texts(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, none).rules == () and quality.fit(odd.where("false"), none).rules == ()
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd, quality.fit(odd, labels)).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((k, len(WORD.findall(t or ""))) for k, t in ODD)
    assert all(not r.kept for r in rows if r.n_words < 20)


def test_quality_learns_from_each_id_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, good, names, **k: seen.append(len(x)) or quality.DecisionList((), True))
    docs = spark.createDataFrame([(1, prose(40, 1))] * 300 + [(2, prose(40, 2))], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert seen == [2]


def test_archives_of_odd_pages(spark):
    long = "<p>é" + LONG * 3
    rows = [(1, "u", long), (1, "u", long), (2, None, long), (3, "v", ""), (3, "v", None), (None, None, None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")
    got = warc.round_trip(spark, pages).collect()
    want = Counter()
    for k, _, h in rows:
        data = (h or "").encode()
        want[k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if k == 2 else "response", 1 if k == 2 else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def walked_tree(page):
    """The tree built by walks over the open elements."""
    tag, parent, stack = ["#"], [-1], [0]
    for m in html.TOKEN.finditer(page):
        name = (m["tag"] or "").lower()
        if not name:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                opened = tag[stack[k]]
                if opened == name:
                    del stack[k:]
                    break
                if opened in html.CONTAINER and (name not in html.CONTAINER or opened == "body"):
                    break
            continue
        ends = ({"p"} if name in html.CLOSES_P else set()) | html.ENDS.get(name, set())
        for k in range(len(stack) - 1, 0, -1):
            if tag[stack[k]] in ends:
                del stack[k:]
                break
            if tag[stack[k]] in html.CONTAINER:
                break
        if name in html.VOID or name in ("html", "body") and name in [tag[x] for x in stack]:
            continue
        tag.append(name)
        parent.append(stack[-1])
        stack.append(len(tag) - 1)
    return tag, parent


def plain_main_text(page):
    """The scoring as the module says it, with a look at every element for every other one."""
    t = html.Tree(page)
    n = len(t.tag)
    up = [[e] for e in range(n)]
    for e in range(1, n):
        up[e] += up[t.parent[e]]
    text = [(e, unescape(s)) for e, s in t.pieces if s is not None]
    shown = [(e, s, len(" ".join(s.split()))) for e, s in text if not t.drop[e]]
    total = [sum(k for e, _, k in shown if x in up[e]) for x in range(n)]
    linked = [sum(k for e, _, k in shown if x in up[e] and "a" in [t.tag[y] for y in up[e]]) for x in range(n)]
    block = [next((x for x in up[e] if t.tag[x] in html.BLOCK), 0) for e in range(n)]
    own = [sum(k for e, _, k in shown if block[e] == x or e == x) for x in range(n)]
    direct = [sum(k for e, _, k in shown if e == x and "a" in [t.tag[y] for y in up[e]]) for x in range(n)]
    commas = [sum(s.count(c) for e, s, k in shown if (block[e] == x or e == x) and k for c in ",،、，;") for x in range(n)]
    named = [next((y for y in up[e][1:] if y > 0 and t.layout[y]), 0) for e in range(n)]
    beside = [sum(own[x] for x in range(n) if t.tag[x] in html.PARAGRAPHS and own[x] >= html.LEAST_POINTS_TEXT and not t.drop[x] and named[e] in (*up[x], 0) and (x if t.layout[x] else named[x]) in (named[e], *([x] if x == named[e] else []))) for e in range(n)]
    believed = [t.layout[e] and (2 * total[e] < total[0] or beside[e] >= html.BESIDE and 10 * beside[e] >= total[e]) for e in range(n)]
    gone = [any(t.drop[y] or believed[y] for y in up[e] if y) for e in range(n)]
    points = {}
    for e in range(1, n):
        if gone[e] or t.tag[e] not in html.PARAGRAPHS or own[e] < html.LEAST_POINTS_TEXT:
            continue
        gain = (1 + commas[e] + min(own[e] / 100, 3)) * (1 - min(1, direct[e] / own[e]))
        chain = up[e] if t.tag[e] in ("div", "section", "article", "main") else up[e][1:]
        for level, x in enumerate([x for x in chain if x > 0][:5]):
            points.setdefault(x, html.CONTENT_TAGS.get(t.tag[x], 0.0) + t.bonus[x])
            points[x] += gain / (1 if level == 0 else 2 if level == 1 else level * 3)
    final = {e: p * (1 - linked[e] / total[e]) if total[e] else 0.0 for e, p in points.items()}
    best = max((e for e in sorted(final) if not gone[e]), key=lambda e: (final[e], -e), default=None)
    if best is None:
        best = next((e for e in range(1, n) if t.tag[e] in ("article", "main") and not gone[e] and total[e]), None)
        if best is None:
            best = next((e for e in range(1, n) if t.tag[e] == "body"), 0)
            if not total[best] or 2 * linked[best] > total[best]:
                return ""
    best = next((x for x in up[best][1:] if x > 0 and t.tag[x] == "article"), best)
    kept = {best}
    if t.tag[best] not in ("article", "main", "body") and best:
        for e in range(1, n):
            if t.parent[e] == t.parent[best] and not gone[e] and total[e]:
                density, stop = linked[e] / total[e], any("." in s for x, s, k in shown if x == e and k)
                plain = t.tag[e] in ("p", "h1", "h2", "h3", "blockquote", "pre") and (density < 0.25 and total[e] > 80 or not density and (t.tag[e][0] == "h" or stop))
                if e in final and final[e] >= max(10.0, 0.2 * final[best]) or plain:
                    kept.add(e)
    keeps = lambda e: any(x in kept for x in up[e]) and not any(gone[x] for x in up[e][: next(i for i, x in enumerate(up[e]) if x in kept) + 1])
    return " ".join("".join(" " if s is None else unescape(s) if keeps(e) else "" for e, s in t.pieces).split())


def test_main_text_by_a_second_implementation():
    r = random.Random(2)
    names = "div p b i a span li ul td tr table body html article section h1 option main header nav form blockquote".split()
    marks = ["", "", "", " class=content", " class='post comments'", " id=sidebar", " hidden", " itemprop=articleBody class=share"]
    found = 0
    for _ in range(700):
        page = "".join(r.choice([f"<{t}{r.choice(marks)}>", f"</{t}>", "Some text, of a few words &amp; more. ", "and a long line of words, with commas, that goes on for a while; it has to end somewhere. ", "x"]) for t in r.choices(names, k=r.randrange(40)))
        t = html.Tree(page)
        assert (t.tag, t.parent) == walked_tree(page)
        assert html.main_text(page) == plain_main_text(page), page
        found += bool(html.main_text(page))
    assert found > 300


def test_names_of_layout_are_believed_of_large_elements():
    part = lambda n, word: "".join(f"<p>{word} paragraph {i}, with a comma, and enough words to count as text of its own.</p>" for i in range(n))
    article = part(6, "Article")
    want = html.main_text(f"<body>{article}</body>")
    assert want.count("Article paragraph") == 6
    for name in ("class=sidebar", "class='cookie-notice'", "id=menu", "class='advert box'", "class=comments"):
        other = f"<div {name}>{part(30, 'Foreign')}</div>"
        for page in (f"<div class=content>{article}</div>{other}", f"{other}<div class=content>{article}</div>", f"<div>{other}<div><div>{article}</div></div></div>", f"<div class='widget'><div>{article}</div>{other}</div>"):
            assert html.main_text(f"<body>{page}</body>") == want, page
        # a name of what wraps the page says nothing
        assert html.main_text(f"<body><h1>Title</h1><div {name}>{article}</div></body>").endswith(want)


def test_main_text_of_odd_pages(spark):
    import time

    article = "<p>A paragraph of an article, with commas, and enough words to count.</p>"
    many = "<body><div><p>" + "long text, of some words, " * 9 + "</p></div>" + "<p>short.</p>" * 200_000
    deep = "<div><b>" * 100_000 + article + "</i>" * 100_000
    began = time.time()
    assert html.main_text(many).count("short.") == 200_000 and html.main_text(deep).startswith("A paragraph")
    assert time.time() - began < 30
    rows = [(1, article), (1, article), (2, None), (None, ""), (3, article * 5000)]
    pages = spark.createDataFrame([(*r, "u", "old", -1) for r in rows], "page_id long, html string, url string, text string, n_chars int")
    got = html.extract(pages).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter((k, len(html.main_text(h))) for k, h in rows)
    assert html.extract(pages.where("false")).count() == 0


def test_stages_of_odd_tables(spark, odd, monkeypatch):
    """Every stage keeps the columns of its documents, whatever their names, and takes an empty table."""
    monkeypatch.setattr(language, "SNIPPETS", 50)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.where("false")):
            after = stage(spark, docs, "/root/testdata/sf0.001")
            assert after.columns == docs.columns, name
            assert after.count() <= 2 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), "/root/testdata/sf0.001").count() == 0
