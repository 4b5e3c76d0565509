"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall by hash into blocks of about BLOCK documents, in random order. The targets say how many draws of its blocks the
mix makes. The tree starts from the vector of these quotas and splits it in halves: what the left half of the shards gets is one draw of
the multivariate hypergeometric distribution, so each leaf holds the quotas that a random deal of all drawn blocks would have given it,
and no deal of all blocks takes place. Each leaf then draws the next blocks of each source, which no other leaf has, and shuffles its
documents by itself. What is taken of a document is what the leaves have drawn. Everything is a function of the seed and the rows, so
runs agree.

Only DataFrame and SQL functions are used. What is kept in one place are tables with a row for each source (targets are ordered
in one task, and a node of the tree is a row with a number for each source), which suits up to some hundred thousand sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the order of the sources' names, repeating.
WEIGHTS = (3, 1, 2)
BLOCK, SUPER = 256, 512
#: Copies of a document at most, and the words of the mix for each word there is.
MOST, SHARE = 2.0, 1.5


def sizes(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, size (words of the whole text; a null has none), a hash of the text and the hash that orders the documents."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text = F.xxhash64("text")
    return docs.select("doc_id", "source", words.alias("size"), text.alias("text_hash"), F.xxhash64(F.lit(seed), "doc_id", text).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: number (by code point, null last), source_size, documents and target. Targets are in proportion to the
    weights and sum to `share` times all sizes; none is above `most` times its source's size.

    With sources in the order of limit / weight, the level of the others once the first i are at their limits rises as long as the
    next one is above its own and falls after that, so its maximum is where resharing ends."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int")).cast("double")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    per = per.withColumn("number", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    everything = Window.partitionBy()
    free = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    levels = per.select("*", (free / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))).alias("level"))
    return levels.withColumn("target", F.least("limit", F.max("level").over(everything) * F.col("weight"))).drop("level", "limit", "weight")


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for a value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(population: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for the number of marked ones among `drawn` of `population`, by inversion from the mode. Probabilities are relative to the
    mode's; places more than 14 deviations off weigh less than a double can tell and are left out."""
    up = "(mk - x + 1D) * (dr - x + 1D) / (CAST(x AS DOUBLE) * (al - mk - dr + x))"  # of p(x - 1), giving p(x)
    down = "(x + 1D) * (al - mk - dr + x + 1D) / ((CAST(mk AS DOUBLE) - x) * (dr - x))"  # of p(x + 1), giving p(x)
    total = lambda seq, step: f"aggregate({seq}, named_struct('w', 1D, 't', 0D), (a, x) -> {_let('w', f'a.w * {step}', 'named_struct(' + repr('w') + ', w, ' + repr('t') + ', a.t + w)')}, a -> a.t)"
    find = lambda seq, step, left: f"aggregate({seq}, named_struct('w', 1D, 'left', {left}, 'x', -1L), (a, x) -> IF(a.x >= 0, a, {_let('w', f'a.w * {step}', 'named_struct(' + repr('w') + ', w, ' + repr('left') + ', a.left - w, ' + repr('x') + ', IF(a.left <= w, x, -1L))')}), a -> a.x)"
    pick = _let("tu", total("ups", up), _let("td", total("downs", down), _let("r", f"{uniform} * (1D + tu + td)",
        f"CASE WHEN r <= 1D THEN m WHEN r <= 1D + tu THEN {_let('got', find('ups', up, '(r - 1D)'), 'IF(got < 0, hi, got)')} ELSE {_let('got', find('downs', down, '(r - 1D - tu)'), 'IF(got < 0, lo, got)')} END")))
    spread = "14D * sqrt(CAST(dr AS DOUBLE) * mk / al * (1D - CAST(mk AS DOUBLE) / al) * (al - dr) / greatest(al - 1, 1)) + 14D"
    body = _let("sd", f"CAST({spread} AS BIGINT)", _let("m", "CAST(floor((dr + 1D) * (mk + 1D) / (al + 2D)) AS BIGINT)", _let("lo", "greatest(0L, dr - (al - mk), m - sd)", _let("hi", "least(dr, mk, m + sd)",
        _let("ups", "IF(hi > m, sequence(m + 1, hi), array())", _let("downs", "IF(m > lo, sequence(m - 1, lo, -1L), array())", pick))))))
    return _let("al", population, _let("mk", marked, _let("dr", drawn, f"CASE WHEN mk = 0 OR dr = 0 THEN 0L WHEN mk = al THEN dr WHEN dr = al THEN mk ELSE {body} END")))


def split(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """From one row (quotas: array) the leaves of the tree: 2**levels rows (shard, quotas). Shards' sums differ by one at most."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "quotas")
    # an integer of 53 bits between 0 and 1, ends excluded
    u = f"(shiftrightunsigned(xxhash64({seed}, depth, node, e.i), 11) + 0.5D) / 9007199254740992D"
    step = f"aggregate(transform(quotas, (q, i) -> named_struct('q', q, 'i', i + 1)), named_struct('pop', aggregate(quotas, 0L, (s, q) -> s + q), 'todo', aggregate(quotas, 0L, (s, q) -> s + q) div 2, 'out', CAST(array() AS ARRAY<BIGINT>)), (acc, e) -> {_let('hit', hypergeometric('acc.pop', 'e.q', 'acc.todo', u), 'named_struct(' + repr('pop') + ', acc.pop - e.q, ' + repr('todo') + ', acc.todo - hit, ' + repr('out') + ', array_append(acc.out, hit))')}, acc -> acc.out)"
    for depth in range(levels):
        split_now = nodes.select("node", "quotas", F.lit(depth).alias("depth")).select("node", "quotas", F.expr(step).alias("left"))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        nodes = split_now.select(F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quotas")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("quotas")))).alias("half")).select("half.*")
    return nodes.select(F.col("node").alias("shard"), "quotas")


def plan(docs: DataFrame, shards: int = 16, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For every row: doc_id, source, size, text_hash, source_size, target, copies (0 to `most`, rounded up), shards, one for each copy, and
    places, which order the documents of a shard: each shard permutes its own.

    The draws of a source go over its blocks pass by pass; the whole passes are floor(target / source_size), and the next one ends at
    the block that no longer fits, of which, from the longest on, the documents are taken that still do. The tree deals the numbers of draws
    to the shards, a shard's draws of a source follow those of the shards before it, and a document is in the mix for each draw of its
    block. Sources without words have the target 0 and no copies. `shards` is a power of two. Null sources are a source, null texts
    have size 0, repeated rows are rows of their own; an empty table gives an empty table."""
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    rows = written(sizes(docs, seed), "sizes")
    per = targets(rows, weights, share, most)
    per = per.withColumn("blocks", F.ceil(F.col("documents") / BLOCK)).withColumn("passes", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) + 1e-12))
    per = written(per.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "sources")
    # no hint: there is a row for each source, and Spark broadcasts them if their size allows it
    known = rows.alias("r").join(per.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    block = F.least(F.col("blocks") - 1, F.floor(F.shiftrightunsigned("h", 11) / float(1 << 53) * F.col("blocks"))).cast("long")
    known = known.select("doc_id", "r.source", "size", "text_hash", "h", "number", block.alias("block"))
    blocks = known.groupBy("number", "block").agg(F.sum("size").alias("words")).withColumn("super", F.floor(F.col("block") / SUPER))
    supers = blocks.groupBy("number", "super").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("number").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("number", "super", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(supers, ["number", "super"]).select("number", "block", "words", (F.col("base") + F.coalesce(F.sum("words").over(inside), F.lit(0))).alias("base"))
    blocks = written(blocks.join(per.select("number", "source_size", "target", "passes", "rest", F.col("blocks").alias("in_source")), "number"), "blocks")
    begun = blocks.where(F.col("base") < F.col("rest")).groupBy("number").agg(F.max("block").alias("last"))
    quotas = per.join(begun, "number", "left").select("number", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("last") + 1, F.lit(0))).cast("long").alias("quota"))
    # one row: a number for each source
    one = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "quota"))), lambda x: x["quota"]).alias("quotas"))
    leaves = split(one, levels, seed).select("shard", F.posexplode("quotas").alias("at", "quota")).select((F.col("at") + 1).alias("number"), "shard", "quota")
    # a row for each shard and source: its quota of draws begins where those of the shards before it end
    dealt = leaves.withColumn("end", F.sum("quota").over(Window.partitionBy("number").orderBy("shard"))).where("quota > 0")
    draws = dealt.join(per.select("number", F.col("blocks").alias("in_source")), "number").select("number", "shard", "in_source", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("draw"))
    # a block is drawn once in each pass at most
    drawn = draws.select("number", "shard", F.expr("draw % in_source").alias("block"), F.expr("draw div in_source").alias("pass")).groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("deal"))
    blocks = blocks.join(drawn, ["number", "block"], "left").select("number", "block", "source_size", "target", "passes", "rest", "base", "words", F.coalesce("deal", F.array().cast("array<struct<pass:bigint,shard:bigint>>")).alias("deal"))
    all_rows = known.join(written(blocks, "drawn"), ["number", "block"])
    cut = (F.col("base") < F.col("rest")) & (F.col("base") + F.col("words") > F.col("rest"))
    place = lambda shards: F.transform(shards, lambda s, i: F.xxhash64(F.lit(seed), F.col("text_hash"), F.col("doc_id"), s, i))
    whole, sure_draws = F.transform("deal", lambda d: d["shard"]), F.transform(F.filter("deal", lambda d: d["pass"] < F.col("passes")), lambda d: d["shard"])
    out = ["doc_id", "source", "size", "text_hash", "source_size", "target", "shards"]
    sure = all_rows.where(~cut).withColumn("shards", whole).select(out)
    # one block of a source is cut: its documents, repeated rows counted once, are taken from the longest on if they still fit
    group = ["number", "h", "doc_id", "text_hash", "size"]
    edge = all_rows.where(cut)
    kinds = edge.groupBy(*group).agg(F.count("*").alias("rows"), F.first(F.col("rest") - F.col("base")).alias("room")).where("size > 0")
    line = kinds.groupBy("number").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "h", "doc_id", "text_hash", "size", "rows"))).alias("line"), F.max("room").alias("room"))
    fits = "aggregate(line, named_struct('room', room, 'out', CAST(array() AS ARRAY<BIGINT>)), (a, d) -> " + _let("k", "least(d.rows, CAST(floor(a.room / d.size) AS BIGINT))", "named_struct('room', a.room - k * d.size, 'out', array_append(a.out, k))") + ", a -> a.out)"
    taken = line.select("number", F.explode(F.arrays_zip("line", F.expr(fits).alias("fit"))).alias("z")).select("number", "z.line.*", "z.fit").where("fit > 0").drop("rows", "order")
    e, t, same = edge.alias("e"), taken.alias("t"), F.lit(True)
    for c in group:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}"))
    turn = F.row_number().over(Window.partitionBy(*(F.col(f"e.{c}") for c in group)).orderBy("base"))
    edge = e.join(t, same, "left").withColumn("turn", turn).select(*(F.col(f"e.{c}") for c in edge.columns), F.coalesce(F.col("turn") <= F.col("fit"), F.lit(False)).alias("again"))
    edge = edge.withColumn("shards", F.when(F.col("again"), whole).otherwise(sure_draws)).select(out)
    return sure.unionByName(edge).withColumn("copies", F.size("shards")).withColumn("places", place(F.col("shards")))


def mix(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The mix itself: the columns of docs, whatever their names, a row for each copy, in the order of the shards and in each shard in the
    order of its places. Rows that agree in doc_id, source and text share their copies evenly, so repeated rows neither multiply nor
    vanish. Null and empty texts have no words and are drawn with their block; an empty table gives an empty one."""
    key = ["doc_id", "source", "text_hash"]
    copies = plan(docs, seed=seed, **options).select(*key, F.arrays_zip("shards", "places").alias("copies"))
    chosen = copies.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("copies"))).alias("copies"), F.count("*").alias("rows")).where(F.size("copies") > 0)
    chosen = chosen.select(*(F.col(k).alias(f"c_{k}") for k in key), "copies", "rows")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    def of(some: DataFrame, turn: Column) -> DataFrame:
        joined = left.join(some.hint("merge"), same).withColumn("turn", turn)
        mine = F.filter("copies", lambda s, i: i % F.col("rows") == F.col("turn") - 1)
        return joined.select("row", F.posexplode(mine).alias("copy", "to")).select("row", "to.shards", "to.places", "copy")

    # only rows that stand more than once need a turn; both joins read the same shuffle of the texts
    found = of(chosen.where("rows = 1"), F.lit(1)).unionByName(of(chosen.where("rows > 1"), F.row_number().over(Window.partitionBy(*key).orderBy("rows"))))
    # by ranges, so that a shard of any size is as many tasks' work as it needs
    return found.repartitionByRange("shards", "places", "copy").sortWithinPartitions("shards", "places", "copy").select("row.*")
