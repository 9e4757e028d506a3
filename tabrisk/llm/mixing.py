"""Mixing sources to target word shares with a multivariate-hypergeometric splitting tree.

1. Sizes: every document falls into one of 2^16 cells of its source by a digest of its id and text; 2^8 cells are a block.
   One aggregation gives the words of each cell. The control tables from here on have as many rows as
   sources times blocks or cells, whatever the corpus holds.
2. Targets: sources share all words by weight; a target stops at `cap` times its source's words and the excess goes
   to the others by weight, which is filling to one common level.
3. Quotas: a target is a number of whole passes over its source and a part of one more. The part is
   the first cells, in the order of the cells' digests, whose words come nearest to the rest.
   Each (pass, block) that is taken is a unit; a source's quota is its number of units.
4. Splitting tree: the quotas are split over 2^depth output shards. At each node of the tree the units of all sources
   are drawn to the left child without replacement, so the counts are multivariate hypergeometric and
   add up exactly. A shard then draws its quota from the source's permuted units, which are disjoint.
5. Every document gets its draws (pass, shard, position key); `mixed` repeats the rows, brings them to the output ranges
   of their shards and orders each.

Only built-in column functions are used. Reruns agree: all draws are digests of `seed` and ids.

Defined results: a null text has size 0 and may be drawn without adding words. A source without words has target 0. Null is
a source of its own, last in the order. Rows that share a doc_id, or have none, fall into cells of their own by their texts;
rows that are equal in id and text are in one cell and are drawn alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm.common import materialize, word_count

CAP = 3
DEPTH = 6
CELLS_PER_BLOCK = 256


def _hex(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    """A text that is equal for equal sources only, and not null for the null one."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _cell(seed: int, key: str, text: str) -> Column:
    """The document's cell, 0 to 65535, by a digest of its id and text; the cell's order is its number."""
    return _hex(F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), F.col("source_key"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))), 1, 4)


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """sizes: source_key, source, source_size. Adds weight (1, 2, 3, repeating in source order) and target.

    The common level is that of the shortest prefix, by words per weight, whose members are held at the cap.
    """
    # one row per source: these windows are over the list of sources, not over documents
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long")).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("held", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("held_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    w = w.withColumn("level", (F.col("total") - F.col("held")).cast("double") / (F.col("weights") - F.col("held_weight")).cast("double"))
    # the first source, in order of room, whose room reaches the level that its predecessors leave
    w = w.withColumn("fits", F.col("most").cast("double") >= F.col("level") * F.col("weight"))
    w = w.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("held_weight"), F.col("level")))).over(everything))
    own = F.col("final.level") * F.col("weight")
    target = F.when(F.col("held_weight") < F.col("final.held_weight"), F.col("most").cast("double")).otherwise(own)
    return w.select("source_key", "source", "source_size", "weight", target.alias("target"))


def cell_draws(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """For every cell that holds documents: its block, full passes and whether the part pass takes it."""
    c = cells.join(targets.select("source_key", "source_size", "target"), "source_key")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    c = c.withColumn("passes", passes).withColumn("rest", F.col("target") - (F.col("passes") * F.col("source_size")).cast("double"))
    # at most 65,536 cells of one source; the order is the cell's number, a digest
    upto = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("through", F.sum("words").over(upto))
    # a cell is taken if that brings the sum nearer to the rest than stopping before it
    middle = F.col("through").cast("double") - F.col("words").cast("double") / 2
    c = c.withColumn("part", (F.col("words") > 0) & (middle < F.col("rest")))
    return c.select("source_key", "cell", F.floor(F.col("cell") / CELLS_PER_BLOCK).cast("long").alias("block"), "passes", "part", "source_size", "target")


def _unit_hash(*parts: Column | int) -> Column:
    """A number in [0, 2^52) from the digest of the parts."""
    return _hex(F.md5(F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts])), 1, 13)


def split_quotas(quotas: DataFrame, depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """quotas: source_key, quota. Returns (source_key, shard, quota): exact quotas of 2^depth shards.

    A node holds the quotas of all sources (one entry per source) and passes half of its units, rounded down, to the left
    child. The units are gone through one by one; each goes left with probability (places left) / (units
    left), which draws without replacement: the left counts are multivariate hypergeometric.
    """
    entry = F.struct(F.col("source_key"), F.col("quota"))
    nodes = quotas.groupBy(F.lit(0).cast("long").alias("node")).agg(F.sort_array(F.collect_list(entry)).alias("q"))
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        start = F.struct((F.floor(F.col("total") / 2)).cast("long").alias("places"), F.col("total").alias("units"), F.lit(0).cast("long").alias("left"))

        def draw(state: Column, i: Column, x: Column, level: int = level) -> Column:
            u = _unit_hash(seed, level, F.col("node"), x["source_key"], i)
            goes = (u.cast("double") * state["units"] < state["places"].cast("double") * F.lit(float(1 << 52))).cast("long")
            return F.struct((state["places"] - goes).alias("places"), (state["units"] - F.lit(1)).alias("units"), (state["left"] + goes).alias("left"))

        def one_source(state: Column, x: Column) -> Column:
            ids = F.when(x["quota"] > 0, F.sequence(F.lit(1).cast("long"), x["quota"])).otherwise(F.array().cast("array<bigint>"))
            first = F.struct(state["places"].alias("places"), state["units"].alias("units"), F.lit(0).cast("long").alias("left"))

            def put(s: Column) -> Column:
                lefts = F.concat(state["lefts"], F.array(s["left"]))
                return F.struct(s["places"].alias("places"), s["units"].alias("units"), lefts.alias("lefts"))

            return F.transform(F.array(F.aggregate(ids, first, lambda s, i: draw(s, i, x))), put)[0]

        begin = F.struct(start["places"].alias("places"), start["units"].alias("units"), F.array().cast("array<bigint>").alias("lefts"))
        nodes = nodes.withColumn("total", total).withColumn("drawn", F.aggregate("q", begin, one_source)["lefts"])
        left = F.transform("q", lambda x, j: F.struct(x["source_key"].alias("source_key"), F.get(F.col("drawn"), j).alias("quota")))
        right = F.transform("q", lambda x, j: F.struct(x["source_key"].alias("source_key"), (x["quota"] - F.get(F.col("drawn"), j)).alias("quota")))
        both = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q"))))
        nodes = materialize(nodes.select(both.alias("x")).select("x.node", "x.q"), "mix-tree")
    flat = nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x"))
    return flat.select("x.source_key", "shard", "x.quota")


def unit_shards(units: DataFrame, shards: DataFrame, seed: int = 0) -> DataFrame:
    """units: source_key, block, pass. Each shard takes the next `quota` units of the source's permuted order."""
    of_source = Window.partitionBy("source_key")
    ranked = units.withColumn("rank", F.row_number().over(of_source.orderBy(_unit_hash(seed, F.col("source_key"), F.col("block"), F.col("pass")), "block", "pass")))
    upto = of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = shards.withColumn("last", F.sum("quota").over(upto)).select(F.col("source_key").alias("k"), "shard", "last", (F.col("last") - F.col("quota")).alias("before"))
    on = (F.col("source_key") == F.col("k")) & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("last"))
    return ranked.join(spans, on).select("source_key", "block", "pass", "shard")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", keep: list[str] | None = None,
        depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """Kept columns (default: the key) with size, source_size, target and `draws`, an array of (pass, shard, position).

    A document without a draw is not in the mix. The columns added replace kept ones of the same name.
    """
    added = ["size", "source_size", "target", "draws"]
    keep = [c for c in (keep if keep is not None else [key]) if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    # the position also goes by the text: rows of one id, or of none, don't stand in one place
    base = docs.select(row, F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
                       F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    base = base.withColumn("source_key", _source_key(F.col("source"))).withColumn("cell", _cell(seed, "id", "text_hash"))
    light = base.select("source_key", "source", "cell", "size")
    cells = materialize(light.groupBy("source_key", "source", "cell").agg(F.sum("size").alias("words")), "mix-cells")
    targets = source_targets(cells.groupBy("source_key", "source").agg(F.sum("words").alias("source_size")))
    drawn = materialize(cell_draws(cells, targets), "mix-draws")

    blocks = drawn.groupBy("source_key", "block").agg(F.max("passes").alias("passes"), F.max(F.col("part").cast("long")).alias("extra"))
    units = materialize(blocks.filter("passes + extra > 0").select("source_key", "block", F.explode(F.expr("sequence(1L, passes + extra)")).alias("pass")), "mix-units")
    quotas = units.groupBy("source_key").agg(F.count(F.lit(1)).alias("quota"))
    placed = unit_shards(units, split_quotas(quotas, depth, seed), seed)
    placed = placed.groupBy("source_key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("placed"))
    plan = materialize(drawn.join(placed, ["source_key", "block"], "left"), "mix-plan")

    out = base.join(plan.select("source_key", "cell", "passes", "part", "source_size", "target", "placed"), ["source_key", "cell"])
    times = F.col("passes") + F.col("part").cast("long")
    mine = F.filter(F.coalesce(F.col("placed"), F.array().cast(plan.schema["placed"].dataType)), lambda x: x["pass"] <= times)
    draws = F.transform(mine, lambda x: F.struct(
        x["pass"].alias("pass"), x["shard"].alias("shard"),
        _unit_hash(seed, x["shard"], x["pass"], F.col("source_key"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_hash")).alias("position")))
    return out.select("row.*", "size", "source_size", "target", draws.alias("draws"))


def mixed(docs: DataFrame, depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """The rows of the mix with the columns of `docs`, repeated as often as drawn.

    Every shard is one range of the output, shuffled within by its position keys. The output partitions are equal parts of
    the order of (shard, position): positions are digests, so the bounds need no sample, and a large shard takes several.
    """
    cols = list(docs.columns)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), "doc_id", "text", "source")
    found = mix(whole, keep=["__row"], depth=depth, seed=seed).filter(F.size("draws") > 0)
    rows = found.select("__row", F.explode("draws").alias("d")).select("__row", "d.shard", "d.position")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = (F.col("shard") + F.col("position").cast("double") / float(1 << 52)) / float(1 << depth)
    part = F.least(F.floor(place * parts), F.lit(parts - 1)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("shard", "position").select("__row.*")


def op1(docs: DataFrame) -> DataFrame:
    found = mix(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('mix0|' || coalesce('s' || source, 'n') || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 4) AS BIGINT) AS cell
  FROM documents),
s AS (SELECT source_key, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
h AS (SELECT *, coalesce(sum(most) OVER o, 0) AS held, coalesce(sum(weight) OVER o, 0) AS held_weight,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - held AS DOUBLE) / CAST(weights - held_weight AS DOUBLE) AS level FROM h),
f AS (SELECT level AS flevel, held_weight AS fweight FROM l WHERE CAST(most AS DOUBLE) >= level * weight ORDER BY held_weight LIMIT 1),
t AS (SELECT source_key, source_size, CASE WHEN held_weight < fweight THEN CAST(most AS DOUBLE) ELSE flevel * weight END AS target FROM l, f),
c AS (SELECT source_key, cell, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
p AS (SELECT c.*, source_size, target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
             sum(words) OVER (PARTITION BY source_key ORDER BY cell) AS through
      FROM c JOIN t USING (source_key))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (passes + CASE WHEN words > 0 AND CAST(through AS DOUBLE) - CAST(words AS DOUBLE) / 2 < target - CAST(passes * source_size AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p USING (source_key, cell)
"""
