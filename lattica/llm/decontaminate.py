"""Benchmark decontamination by winnowing.

Of every WINDOW - GRAM + 1 neighbouring runs of GRAM words the least hash is kept as a fingerprint, with its place. A span of WINDOW words
that a document shares with a benchmark item has the same least hash on both sides, so documents without a common fingerprint share no
such span. At a common fingerprint the document's words are extended to the whole windows around it, and these are compared with the item's
windows word for word. An item of fewer words is one window; documents look for it at every place, in the same scan. Words are cut into
stretches that overlap by a window less a word, so each window lies in one stretch and the work on a long text is in proportion to it.

Only DataFrame and SQL functions are used; long work is in array functions on one row, and what is joined are fingerprints. The benchmark's
side of a join is broadcast if its measured bytes allow it and joined by a shuffle beyond that.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, GRAM = 13, 8
#: Words of a stretch.
STRETCH = 1 << 15
#: Words by the characters that they have: a class of ranges to keep is matched several times as fast as its complement.
WORD = r"([0-9a-z\x{80}-\x{10FFFF}]+)"
#: Bytes of the benchmark's side of a join up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
#: Fingerprints of a benchmark up to which documents look for them in a table of BITS_EACH bits for each (2 MB at most); beyond, they are joined.
ARRAY_ROWS, BITS_EACH = 262_144, 64
#: A fingerprint is 33 bits of hash over 30 bits of place.
_PLACE = 30


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(1))


def _next(column: str, step: int) -> Column:
    """The array from its element `step` on."""
    return F.slice(column, F.lit(step + 1), F.size(column))


def _with_runs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df and r1 (the words) and, for each of the lengths and the powers of two below them, r<length>: a hash of each run of so many of the
    array `words`. Runs of a power of two double those of half of it; other runs are two of the power below that overlap. Behind the last whole
    run stand others, which are none."""
    df, power = df.withColumn("r1", F.col("words")), 1
    while 2 * power <= max(lengths):
        df = df.withColumn(f"r{2 * power}", F.zip_with(f"r{power}", _next(f"r{power}", power), lambda a, b: F.xxhash64(a, b)))
        power *= 2
    for n in lengths:
        low = 1 << (n.bit_length() - 1)
        if low < n:
            df = df.withColumn(f"r{n}", F.zip_with(f"r{low}", _next(f"r{low}", n - low), lambda a, b: F.xxhash64(a, b)))
    return df


def _packed(n: int) -> Column:
    """The whole runs of n words as fingerprints: hash and place."""
    whole = F.slice(f"r{n}", F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0)))
    return F.transform(whole, lambda h, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(h), 64 - 33), _PLACE).bitwiseOR(i.cast("long")))


def _fingerprints(df: DataFrame, short: list[int], long: int | None) -> DataFrame:
    """df, which has `words`, and f<length> for each of the lengths: every run of a short one; of the windows of the long one the least hash of their
    runs of GRAM words, the first of equal ones. Minima over windows are two of the power of two below that overlap."""
    own = list(df.columns)
    df = _with_runs(df, short + ([GRAM] if long else []))
    if not long:
        return df.select(*own, *[_packed(n).alias(f"f{n}") for n in short])
    df, have, width = df.select(*own, *[f"r{n}" for n in short if n != GRAM], f"r{GRAM}", _packed(GRAM).alias("m")), 1, long - GRAM + 1
    while have < width:
        step = min(have, width - have)
        df = df.withColumn("m", F.zip_with("m", _next("m", step), lambda a, b: F.least(a, b)))
        have += step
    return df.select(*own, *[_packed(n).alias(f"f{n}") for n in short], F.array_distinct("m").alias(f"f{long}"))


def _hash(f) -> Column:
    return F.shiftright(f, _PLACE)


def _at(f: Column) -> Column:
    return f.bitwiseAND((1 << _PLACE) - 1).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """df, a written table, marked for a broadcast if its strings and numbers have BROADCAST_BYTES at most, counted here."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(0)) + 24 for c, t in df.dtypes)
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def _bit_table(marks: DataFrame, n: int) -> tuple[Column, int]:
    """(a constant array of words, number of bits): bit hash % number is set for each of the n marks. There are n * BITS_EACH bits, so a value that is
    no mark is taken for one with a probability below 1 / BITS_EACH; only the comparison of words, not a result, depends on it. The array is a string
    here, split and folded by Spark's optimizer."""
    size = max(64, n * BITS_EACH)
    at = F.pmod(F.col("hash"), F.lit(size).cast("long"))
    words = marks.select(F.shiftright(at, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
    words = words.groupBy("i").agg(F.bit_or("bit").alias("bits"))
    every = marks.sparkSession.range(-(-size // 64)).withColumnRenamed("id", "i").join(words, "i", "left")
    line = every.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("bits", F.lit(0)).cast("string").alias("bits")))).alias("line"))
    return F.split(F.lit(line.select(F.array_join(F.transform("line", lambda x: x["bits"]), ",")).first()[0]), ",").cast("array<bigint>"), size


def _stretches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, first, words: each text's words in stretches from word `first` on; one without words has one empty stretch."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(words_of("text"), F.array().cast("array<string>")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRETCH))
    cut = F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice("words", i + 1, F.lit(STRETCH + WINDOW - 1)).alias("words")))
    # outer: no filter is inferred that would cut the words twice
    return rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.explode_outer(cut).alias("s")).select("doc_id", "text_hash", "n_words", "s.*")


def _spots(lengths: list[int], long: int | None) -> Column:
    """at, length and words of the windows of a stretch that have a known fingerprint, in p<length>."""
    around = lambda p: F.transform(F.sequence(p - (long - GRAM), p), lambda a: F.struct(a.alias("at"), F.lit(long).alias("length")))
    own = lambda n: lambda p: F.struct(p.alias("at"), F.lit(n).alias("length"))
    each = [F.flatten(F.transform(f"p{n}", around)) if n == long else F.transform(f"p{n}", own(n)) for n in lengths]
    inside = F.filter(F.array_distinct(F.concat(*each)), lambda s: (s["at"] >= 0) & (s["at"] + s["length"] <= F.size("words")))
    text = lambda s: F.array_join(F.slice("words", s["at"] + 1, s["length"]), " ")
    return F.transform(inside, lambda s: F.struct((F.col("first") + s["at"]).alias("at"), s["length"].alias("length"), text(s).alias("words_text")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs, and text_hash, by which rows with the same
    doc_id are told apart.

    An item's windows are its runs of WINDOW words; an item with fewer words is one window, one with none has none. A word of a document
    is hit if a window occurs over it. Null texts have no words; items with a null id are found but not listed. Empty tables give empty
    results; without items nothing is hit. Texts and items may have any length; repeated rows get equal results. Documents are scanned once, or
    twice where the benchmark has more than ARRAY_ROWS fingerprints."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0)
    # items of the same words are one class: their windows are listed once
    items = items.withColumn("class", F.xxhash64("words"))
    members = written(items.select("class", "item_id").where("item_id IS NOT NULL").distinct(), "members")
    kinds = written(items.groupBy("class").agg(F.first("words").alias("words")).withColumn("length", F.least(F.lit(WINDOW), F.size("words"))), "kinds")
    lengths = sorted(r.length for r in kinds.select("length").distinct().collect())  # WINDOW numbers at most
    rows = docs.select("doc_id", "text")
    if not lengths:
        bare = rows.select("doc_id", F.coalesce(F.size(words_of("text")), F.lit(0)).cast("long").alias("n_words"), F.xxhash64("text").alias("text_hash"))
        return _result(bare.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items")))
    long = WINDOW if WINDOW in lengths else None
    short = [n for n in lengths if n != long]
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda i: F.array_join(F.slice("words", i, F.col("length")), " "))
    windows = written(kinds.select("class", F.explode(F.array_distinct(cut)).alias("words_text")), "windows")
    of_item = [F.when(F.col("length") == n, F.col(f"f{n}")) for n in lengths]
    marks = _fingerprints(kinds, short, long).select(F.explode(F.coalesce(*of_item)).alias("f")).select(_hash("f").alias("hash")).distinct()
    marks = written(marks, "marks")
    n_marks = marks.count()
    stretches = _stretches(rows)
    key = ["doc_id", "text_hash"]
    if n_marks <= ARRAY_ROWS:
        # the benchmark alone decides this: its fingerprints are one table of bits, and no document moves before a hit is known
        bits, size = _bit_table(marks, n_marks)

        def known(f: Column) -> Column:
            at = F.pmod(_hash(f), F.lit(size).cast("long"))
            return F.call_function("shiftright", bits[F.shiftright(at, 6).cast("int")], at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

        found = _fingerprints(stretches, short, long)
        found = found.select(*stretches.columns, *[F.transform(F.filter(f"f{n}", known), _at).alias(f"p{n}") for n in lengths])
    else:
        own = lambda n: lambda f: F.struct(F.lit(n).alias("length"), f.alias("f"))
        every = F.flatten(F.array(*[F.transform(f"f{n}", own(n)) for n in lengths]))
        each = _fingerprints(stretches, short, long).select(*key, "first", F.explode_outer(every).alias("e")).select(*key, "first", "e.length", _hash("e.f").alias("hash"), _at(F.col("e.f")).alias("at"))
        each = each.join(_small(marks), "hash", "left_semi")
        places = [F.collect_set(F.when(F.col("length") == n, F.col("at"))).alias(f"p{n}") for n in lengths]  # of one stretch
        hits, t = written(each.groupBy(*key, "first").agg(*places), "hits").hint("merge").alias("h"), stretches.alias("t")
        same = F.col("t.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("t.text_hash") == F.col("h.text_hash")) & (F.col("t.first") == F.col("h.first"))
        found = t.join(hits, same, "left").select("t.*", *[F.coalesce(f"h.p{n}", F.array().cast("array<int>")).alias(f"p{n}") for n in lengths])
    seen = written(found.select(*key, "n_words", "first", _spots(lengths, long).alias("spots")), "seen")
    distinct = _small(windows.select("words_text").distinct())
    spans = seen.select(*key, F.explode("spots").alias("s")).select(*key, "s.*").join(distinct, "words_text").distinct()
    spans = written(spans, "spans")
    add = lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(a["end"], s["at"]))).alias("n"))
    cover = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "length"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda a: a["n"].cast("long"))
    hit = spans.groupBy(*key).agg(cover.alias("n_hit"))
    of_class = spans.select(*key, "words_text").distinct().join(_small(windows), "words_text").select(*key, "class").distinct()
    listed = of_class.join(_small(members), "class").groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    listed = listed.select(*key, F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("items"))
    a, b = hit.alias("a"), listed.alias("b")
    hit = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash")), "left").select("a.*", "b.n_items", "b.items").alias("x")
    every = seen.where("first = 0").select(*key, "n_words").alias("e")
    out = every.join(hit, F.col("e.doc_id").eqNullSafe(F.col("x.doc_id")) & F.col("e.text_hash").eqNullSafe(F.col("x.text_hash")), "left")
    return _result(out.select("e.*", F.coalesce("x.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("x.n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("x.items", F.lit("")).alias("items")))


def _result(df: DataFrame) -> DataFrame:
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode("items", "UTF-8"), 256).alias("items_sha256"), contaminated.alias("contaminated"), "text_hash")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs, whatever their names. Null and empty texts have no words and stay;
    repeated rows stay or go together; an empty benchmark takes nothing away, and an empty table stays empty."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), "text_hash").distinct().hint("merge")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")
