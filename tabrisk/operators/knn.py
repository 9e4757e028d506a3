"""Exact nearest-neighbour imputation.

Semantics (Troyanskaya et al. 2001, as in common KNN imputers): a missing value of column j in row q
becomes the mean of column j over the k fit rows ("donors") nearest to q among those where j is
present. Distance over the coordinates present in both rows, scaled up by the share present:

    d(q, p) = sqrt(n_cols / n_both * sum over both-present i of (q_i - p_i)^2)

A pair without any shared coordinate is skipped. Fewer than k donors -> mean of those; none -> the
column mean of the fit rows. Ties in distance go to the lower donor id. NaN counts as missing.

Plan. Donors are laid out once, at the fit: by the columns they miss, then along a Z-order curve of quantile codes, in
ranges of that order, the blocks. A block's box (bounds, counts of present values per column, smallest donor number) gives a
lower bound of its distance to any row. The boxes are the only data sent to every task; there are at most ``MAX_BLOCKS``, as
blocks grow with the table. Incomplete rows are put in chunks by the block they are nearest to, so that the rows of a chunk want the
same blocks. A chunk first visits the nearest blocks that hold k donors for each missing value of its rows, then every other block whose
bound does not exceed the k-th distance of one of them. The bound adds up the same terms in the same order as the distance, so
rounding cannot cut a donor off, and the search is exact whichever columns have gaps; where data don't
cluster it comes down to visiting every block. A task holds a chunk and streams the donors of a span of blocks past it; what travels
is each span once per chunk that visits it, and k donors per missing value and span come out, however many blocks were met.
Distances come from a matrix product first; the pairs that its rounding leaves open are computed term by term.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.operators.features import _ColsParams
from tabrisk.plans.stored import stored

QUERY_ROWS = 2048  # rows of a chunk that are compared at a time
DONOR_ROWS = 256  # with so many donors
CHUNK_ROWS = (256, 65_536)  # incomplete rows in a chunk, fewer of them in a small table, so that every core has some
SPAN_ROWS = 1 << 20  # donors in a task's span of blocks
BLOCK_ROWS = 1024  # donors in a block, more where MAX_BLOCKS blocks don't hold the table
MAX_BLOCKS = 16_384  # bounds the boxes that every task gets
MAX_TASKS = 20_000
CODE_BITS = 6  # quantile codes of a column along the curve


class _KnnParams(_ColsParams):
    idCol = Param(Params._dummy(), "idCol", "donor id that breaks ties ('' = a hash of the donor's values)", typeConverter=TypeConverters.toString)
    k = Param(Params._dummy(), "k", "donors per missing value", typeConverter=TypeConverters.toInt)


class _Boxes:
    """The boxes of all blocks, by smallest donor number, so that equal bounds are taken in the order of ties."""

    def __init__(self, rows: Sequence, cols: int):
        import numpy as np
        rows = sorted(rows, key=lambda r: r["first"])
        self.b = np.array([r["b"] for r in rows], dtype=np.int64)
        self.first = np.array([r["first"] for r in rows], dtype=np.int64)
        self.has = np.array([r["has"] for r in rows], dtype=np.int64).reshape(-1, cols)
        self.lo, self.hi = (np.array([r[c] for r in rows], dtype=float).reshape(-1, cols) for c in ("lo", "hi"))
        self.rows = np.array([r["rows"] for r in rows], dtype=np.int64)
        self.whole = self.has == self.rows[:, None]

    def bounds(self, x):
        """(row, block): no donor of the block is nearer. A column counts as shared if any donor has it, its gap if all have it."""
        import numpy as np
        total = np.zeros((len(x), len(self.b)))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for i in range(x.shape[1]):
                at = x[:, i, None]
                gap = np.maximum(self.lo[None, :, i] - at, at - self.hi[None, :, i])
                total += np.where(self.whole[None, :, i] & (gap > 0), gap * gap, 0.0)
            both = (~np.isnan(x)).astype(float) @ (self.has > 0).T.astype(float)
            return np.where(both > 0, np.sqrt(x.shape[1] / both * total), np.inf)

    def parts(self, n: int) -> Iterator[slice]:
        step = max(1, (1 << 20) // max(1, len(self.b)))
        return (slice(i, min(n, i + step)) for i in range(0, n, step))

    def home(self, x):
        """Per row the block with the smallest bound, -1 if no block shares a column."""
        import numpy as np
        out = np.full(len(x), -1, dtype=np.int64)
        if len(self.b):
            for part in self.parts(len(x)):
                bound = self.bounds(x[part])
                at = bound.argmin(axis=1)
                out[part] = np.where(np.isfinite(bound[np.arange(len(at)), at]), self.b[at], -1)
        return out

    def nearest(self, x, k: int):
        """Mask of the blocks that are among the nearest ones holding k donors for each missing column of a row."""
        import numpy as np
        out = np.zeros(len(self.b), dtype=bool)
        for part in self.parts(len(x)):
            bound = self.bounds(x[part])
            order = np.argsort(bound, axis=1, kind="stable")
            for row, line, by in zip(x[part], bound, order, strict=True):
                by = by[: np.count_nonzero(np.isfinite(line))]
                for j in np.flatnonzero(np.isnan(row)):
                    mine = by[self.has[by, j] > 0]
                    out[mine[: np.searchsorted(np.cumsum(self.has[mine, j]), k) + 1]] = True
        return out

    def others(self, x, dist, donor):
        """Mask of the blocks that may hold a nearer donor, or as near a one with a smaller number, for a missing column of a row."""
        import numpy as np
        out = np.zeros(len(self.b), dtype=bool)
        for part in self.parts(len(x)):
            bound = self.bounds(x[part])
            for j in range(x.shape[1]):
                at = np.flatnonzero(np.isnan(x[part, j]))
                line, d, p = bound[at], dist[part, j][at, None], donor[part, j][at, None]
                open_ = (line < d) | ((line == d) & np.isfinite(line) & (self.first[None, :] < p))
                out |= (self.has[:, j] > 0) & open_.any(axis=0)
        return out


class _Block:
    """A chunk of incomplete rows with the nearest donors seen so far for each missing value.

    ``limit`` holds per row and column the distance and number of a donor that new ones must come before.
    """

    def __init__(self, queries, values, k: int, limit=None):
        import numpy as np
        self.queries, self.values, self.k = queries, values, k
        self.missing = {j: rows for j in range(values.shape[1]) if len(rows := np.flatnonzero(np.isnan(values[:, j])))}
        self.dist = {j: np.full((len(rows), k), np.inf) for j, rows in self.missing.items()}
        self.value = {j: np.full((len(rows), k), np.nan) for j, rows in self.missing.items()}
        self.donor = {j: np.full((len(rows), k), np.iinfo(np.int64).max) for j, rows in self.missing.items()}
        self.place = np.full(values.shape[::-1], -1)  # of a row among those that miss the column
        for j, rows in self.missing.items():
            self.place[j, rows] = np.arange(len(rows))
        self.limit = limit or (np.full(values.shape, np.inf), np.full(values.shape, np.iinfo(np.int64).max))
        self.there = ~np.isnan(values)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.where(self.there, values, 0.0)
            self.left = np.concatenate([x * x, x, self.there], axis=1)
            self.norm = (x * x).sum(axis=1)
        self.reach = np.full(len(values), -np.inf)  # the largest distance of use to the row
        for j, rows in self.missing.items():
            self.reach[rows] = np.maximum(self.reach[rows], self._kth(j, self.place[j, rows])[0])

    def _kth(self, j: int, at):
        """(distance, number) of the rows at these places among those that miss j: a donor is taken if it comes before."""
        import numpy as np
        rows, d, p = self.missing[j][at], self.dist[j][at, -1], self.donor[j][at, -1]
        ld, lp = self.limit[0][rows, j], self.limit[1][rows, j]
        mine = (d < ld) | ((d == ld) & (p < lp))
        return np.where(mine, d, ld), np.where(mine, p, lp)

    def meet(self, donors, numbers) -> None:
        """Donors of one block or a part of it, in any order."""
        import numpy as np
        seen = ~np.isnan(donors)
        box = [{"b": 0, "first": 0, "rows": len(donors), "has": seen.sum(axis=0), "lo": np.where(seen, donors, np.inf).min(axis=0), "hi": np.where(seen, donors, -np.inf).max(axis=0)}]
        bound = _Boxes(box, donors.shape[1]).bounds(self.values)[:, 0]
        active = np.flatnonzero((bound <= self.reach) & np.isfinite(bound))
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.where(seen, donors, 0.0)
            right = np.concatenate([seen, -2 * x, x * x], axis=1).T
            norm = (x * x).sum(axis=1)
        for lo in range(0, len(active), QUERY_ROWS):
            for at in range(0, len(donors), DONOR_ROWS):
                part = slice(at, at + DONOR_ROWS)
                self._compare(active[lo : lo + QUERY_ROWS], donors[part], numbers[part], seen[part], right[:, part], norm[part])

    def _compare(self, rows, donors, numbers, seen, right, norm) -> None:
        import numpy as np
        cols = donors.shape[1]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            # |product - exact sum| stays far below slack; where either overflows, the comparison is with NaN and the pair stays open
            slack = 1e-15 * (3 * cols + 8) * (self.norm[rows][:, None] + norm[None, :])
            both = self.there[rows].astype(float) @ seen.T.astype(float)
            limit = self.reach[rows] ** 2 * (1 + 1e-9) / cols
            out = self.left[rows] @ right - slack > limit[:, None] * both
        r, c = np.nonzero(~out & (both > 0))
        if not len(r):
            return
        r, total, both = rows[r], np.zeros(len(r)), np.zeros(len(r))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for i in range(cols):
                d = self.values[r, i] - donors[c, i]
                shared = ~np.isnan(d)
                both += shared
                total += np.where(shared, d * d, 0.0)
            dist = np.where(both > 0, np.sqrt(cols / both * total), np.inf)
        for j in self.missing:
            use = np.flatnonzero((self.place[j, r] >= 0) & seen[c, j] & np.isfinite(dist))
            row, d, p, v = self.place[j, r[use]], dist[use], numbers[c[use]], donors[c[use], j]
            kd, kp = self._kth(j, row)
            use = (d < kd) | ((d == kd) & (p < kp))
            if use.any():
                self._take(j, row[use], d[use], p[use], v[use])
        hit = np.unique(r)
        self.reach[hit] = -np.inf
        for j, mine in self.missing.items():
            at = self.place[j, hit]
            at = at[at >= 0]
            self.reach[mine[at]] = np.maximum(self.reach[mine[at]], self._kth(j, at)[0])

    def _take(self, j: int, row, d, p, v) -> None:
        """The k first of the held and the new donors, by distance and number."""
        import numpy as np
        k, hit = self.k, np.unique(row)
        who = np.concatenate([np.repeat(hit, k), row])
        d, p, v = (np.concatenate([held[j][hit].ravel(), new]) for held, new in ((self.dist, d), (self.donor, p), (self.value, v)))
        order = np.lexsort((p, d, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = order[rank < k]
        for held, new in ((self.dist, d), (self.donor, p), (self.value, v)):
            held[j][hit] = new[best].reshape(len(hit), k)

    def nearest(self):
        import numpy as np
        import pandas as pd
        parts = []
        for j, rows in self.missing.items():
            r, c = np.nonzero(np.isfinite(self.dist[j]))
            parts.append(pd.DataFrame({"q": self.queries[rows][r], "col": np.int32(j), "d": self.dist[j][r, c], "p": self.donor[j][r, c], "v": self.value[j][r, c]}))
        return pd.concat(parts) if parts else pd.DataFrame({"q": [], "col": [], "d": [], "p": [], "v": []}).astype({"q": "int64", "col": "int32", "p": "int64"})


def _chunks(loads: Sequence[tuple[int, int]], rows: int) -> list[tuple[int, int, int]]:
    """(home block, its first chunk, its chunks): small neighbours share a chunk, a large home is dealt over several."""
    out, at, held = [], 0, 0
    for home, n in sorted(loads):
        if held and held + n > rows:
            at, held = at + 1, 0
        parts = -(-n // rows)
        out.append((home, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


def _visits(queries: DataFrame, blocks, tasks: int, seen: DataFrame | None = None) -> DataFrame:
    """The rows of all chunks, and a row per chunk c with ``bs``, the blocks that it visits, without those that it has ``seen``."""
    found = queries.repartition(tasks, "c").sortWithinPartitions("c").mapInPandas(blocks, "c long, bs array<long>")
    if seen is not None:
        old = seen.filter(F.col("bs").isNotNull()).select("c", F.col("bs").alias("old"))
        found = found.join(old, "c").select("c", F.array_except("bs", "old").alias("bs"))
    return queries.unionByName(stored(found, "knn-visits"), allowMissingColumns=True)


class KnnImputerModel(Model, _KnnParams, MLReadable, MLWritable):
    """Fitted state: the donors (number n in id order, values x, block b), the boxes and the column means. A stage like any other."""

    def __init__(self, donors: DataFrame | None = None, boxes: DataFrame | None = None, means: Sequence[float | None] = ()):
        super().__init__()
        self.donors, self.boxes, self.means = donors, boxes, list(means)

    def write(self) -> MLWriter:
        return _KnnWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KnnReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, feats, k = df.sparkSession, self.getInputCols(), self.getOrDefault(self.k)
        x = _values(feats)
        gap = F.exists(x, lambda v: F.isnan(v))
        whole = df.filter(~gap)
        rows = stored(df.filter(gap).withColumn("_q", F.monotonically_increasing_id()), "knn-rows")
        x = rows.select(F.col("_q").alias("q"), x.alias("x"))
        boxes = spark.sparkContext.broadcast(_Boxes(self.boxes.collect(), len(feats)))  # MAX_BLOCKS rows at most
        homes = stored(x.mapInPandas(_home_block(boxes), "q long, x array<double>, home long").filter("home >= 0"), "knn-homes")
        loads = [(r["home"], r["count"]) for r in homes.groupBy("home").count().collect()]  # a row per block
        cores = spark.sparkContext.defaultParallelism
        size = min(CHUNK_ROWS[1], max(CHUNK_ROWS[0], -(-sum(n for _, n in loads) // (2 * cores))))
        packed = _chunks(loads, size)
        tasks = max(cores, min(MAX_TASKS, packed[-1][1] + packed[-1][2] if packed else 1))
        places = F.broadcast(spark.createDataFrame(packed, "home long, first long, parts int"))
        chunk = F.col("first") + F.pmod(F.xxhash64("q"), F.col("parts"))
        chunks = stored(homes.join(places, "home").select(chunk.alias("c"), "q", "x"), "knn-chunks")
        w = Window.partitionBy("q", "col").orderBy("d", "p")
        no = F.lit(None).cast("array<struct<col:int,d:double,p:long>>")
        first = _visits(chunks.withColumn("kth", no), _near_blocks(boxes, k), tasks)
        near = stored(self._meet(first).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k), "knn-near")
        kth = near.filter(F.col("r") == k).groupBy("q").agg(F.collect_list(F.struct("col", "d", "p")).alias("kth"))
        again = _visits(stored(chunks.join(kth, "q", "left").select("c", "q", "x", "kth"), "knn-again"), _other_blocks(boxes), tasks, first)
        near = near.drop("r").unionByName(self._meet(again))
        top = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        found = top.groupBy("q").pivot("col", list(range(len(feats)))).agg(F.avg("v"))
        filled = rows.join(found, rows["_q"] == found["q"], "left")
        place = {c: i for i, c in enumerate(feats)}

        def out(frame: DataFrame, impute: bool) -> DataFrame:
            cols = []
            for f in df.schema.fields:
                c = F.col(f"`{f.name}`")
                if f.name in place:
                    i = place[f.name]
                    c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
                    if impute:
                        c = F.coalesce(c, F.col(f"`{i}`"), F.lit(self.means[i]).cast("double"))
                cols.append(c.alias(f.name))
            return frame.select(*cols)

        return out(whole, False).unionByName(out(filled, True))

    def _meet(self, visits: DataFrame) -> DataFrame:
        """(q, col, d, p, v): the k nearest donors for each missing value within each span of blocks that the row's chunk visits."""
        k, spark = self.getOrDefault(self.k), visits.sparkSession
        span = max(1, int(SPAN_ROWS // (self.boxes.agg(F.avg("rows")).first()[0] or 1)))
        pairs = visits.filter(F.col("bs").isNotNull()).select("c", F.explode("bs").alias("b")).withColumn("g", F.floor(F.col("b") / span))
        queries = visits.filter(F.col("bs").isNull())
        spans = stored(pairs.select("c", "g").distinct(), "knn-spans")
        none = F.lit(None).cast(queries.schema["kth"].dataType)
        rows = queries.join(spans, "c").select("c", "g", F.lit(-1).cast("long").alias("b"), F.col("q").alias("n"), "x", "kth")
        donors = self.donors.join(pairs, "b").select("c", "g", "b", "n", "x", none.alias("kth"))
        tasks = max(spark.sparkContext.defaultParallelism, min(spans.count(), MAX_TASKS))
        dealt = rows.unionByName(donors).repartition(tasks, "c", "g").sortWithinPartitions("c", "g", "b", "n")
        return dealt.mapInPandas(_nearest_in_span(k), "q long, col int, d double, p long, v double")

    def save(self, path: str) -> None:
        self.write().overwrite().save(path)


class KnnImputer(Estimator, _KnnParams, MLReadable, MLWritable):
    """F3 estimator: ``inputCols`` are imputed (and become double), ``idCol`` orders the donors."""

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None, idCol: str = "", k: int = 5):
        super().__init__()
        self._setDefault(inputCols=[], idCol="", k=5)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> KnnImputerModel:
        from tabrisk.plans.ordering import ranked
        feats, idc = self.getInputCols(), self.getOrDefault(self.idCol)
        x = _values(feats)
        key = F.col(idc) if idc else F.xxhash64(*[F.col(c) for c in feats])
        rows = df.select(key.alias("id"), x.alias("x"))
        # donors are numbered in id order, so that a tie goes to the lower id of any type
        numbered = ranked(rows, [F.col("id").asc_nulls_first(), F.col("x").asc()], "n")
        n, curve = _curve(numbered, len(feats))
        blocks = min(MAX_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
        rows = numbered.select("n", "x", F.transform("x", lambda v: F.isnan(v)).alias("gaps"), *[c.alias(f"z{i}") for i, c in enumerate(curve)])
        order = ["gaps", *[f"z{i}" for i in range(len(curve))], "n"]  # equal donors stay in id order
        laid = rows.repartitionByRange(blocks, *order).sortWithinPartitions("n")
        donors = stored(laid.select("n", "x", F.spark_partition_id().cast("long").alias("b")), "knn-donors")
        values = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(len(feats))]
        boxes = stored(donors.groupBy("b").agg(
            F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"), F.array(*[F.count(v) for v in values]).alias("has"),
            F.array(*[F.min(v) for v in values]).alias("lo"), F.array(*[F.max(v) for v in values]).alias("hi")), "knn-boxes")
        r = donors.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
        model = KnnImputerModel(donors, boxes, [r[f"m{i}"] for i in range(len(feats))])
        return model._set(inputCols=feats, idCol=idc, k=self.getOrDefault(self.k))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


def _values(feats: Sequence[str]):
    """The features as an array of doubles, NaN where missing."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in feats])


def _curve(rows: DataFrame, cols: int) -> tuple[int, list[Column]]:
    """Number of rows, and the columns that lay them out: a Z-order number of quantile codes, then the values.

    The next bit always comes from the column with the widest spread left, each bit halving it: distances are in the
    columns' own units, so a wide column is cut finer. Behind its last bit, the values follow, widest column first.
    """
    value = [F.col("x")[i] for i in range(cols)]
    steps = [i / (1 << CODE_BITS) for i in range(1, 1 << CODE_BITS)]
    n, *cuts = rows.agg(F.count(F.lit(1)), *[F.percentile_approx(F.when(~F.isnan(v), v), steps) for v in value]).first()
    spread = [c[-1] - c[0] if c else 0.0 for c in cuts]
    left, used, places = list(spread), [0] * cols, []
    while len(places) < 60:
        i = max(range(cols), key=lambda c: left[c])
        if used[i] == CODE_BITS or not left[i] > 0:
            break
        used[i] += 1
        left[i] /= 2
        places.append((i, CODE_BITS - used[i]))

    def code(v: Column, bounds: Sequence[float]) -> Column:
        return F.size(F.filter(F.lit(list(bounds)), lambda cut: cut < v))

    codes = [code(v, c) if c else F.lit(0) for v, c in zip(value, cuts, strict=True)]
    bit = [F.shiftleft(F.shiftright(codes[i], t).bitwiseAND(F.lit(1)).cast("long"), len(places) - 1 - at) for at, (i, t) in enumerate(places)]
    widest = sorted(range(cols), key=lambda c: -spread[c])
    return n, [reduce(Column.bitwiseOR, bit, F.lit(0).cast("long")), F.array(*[value[c] for c in widest])]


def _numbers(frame):
    import numpy as np
    return np.stack(frame["x"].to_list()).astype(float)


def _limits(kth: Sequence, shape: tuple[int, int]):
    """Distance and number of the k-th donor per row and column, infinite where there is none."""
    import numpy as np
    dist, donor = np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max)
    for at, found in enumerate(kth):
        for one in found if found is not None else []:
            dist[at, one["col"]], donor[at, one["col"]] = one["d"], one["p"]
    return dist, donor


def _home_block(boxes):
    def run(frames: Iterator):
        for frame in frames:
            if len(frame):
                yield frame.assign(home=boxes.value.home(_numbers(frame)))

    return run


def _per_chunk(boxes, mask):
    """Rows come by chunk: (c, blocks that any of its rows wants)."""

    def run(frames: Iterator):
        import numpy as np
        import pandas as pd
        at, want = None, None
        for frame in frames:
            for c, part in frame.groupby("c", sort=True):
                if c != at:
                    if at is not None:
                        yield pd.DataFrame({"c": [at], "bs": [boxes.value.b[want]]})
                    at, want = c, np.zeros(len(boxes.value.b), dtype=bool)
                want |= mask(boxes.value, part)
        if at is not None:
            yield pd.DataFrame({"c": [at], "bs": [boxes.value.b[want]]})

    return run


def _near_blocks(boxes, k: int):
    return _per_chunk(boxes, lambda known, part: known.nearest(_numbers(part), k))


def _other_blocks(boxes):
    def mask(known, part):
        x = _numbers(part)
        return known.others(x, *_limits(part["kth"], x.shape))

    return _per_chunk(boxes, mask)


def _nearest_in_span(k: int):
    """Rows come by (chunk, span): the incomplete rows first, then the donors by block and number."""

    def run(frames: Iterator):
        import numpy as np
        at, block, held = None, None, []
        for frame in frames:
            marks = frame[["c", "g", "b"]].to_numpy()
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(frame)], strict=True):
                if lo == hi:
                    continue
                part, key = frame.iloc[lo:hi], tuple(marks[lo][:2])
                if key != at:
                    if block is not None:
                        yield block.nearest()
                    at, block, held = key, None, []
                numbers, values = part["n"].to_numpy(), _numbers(part)
                if marks[lo][2] < 0:
                    held.append((numbers, values, _limits(part["kth"], values.shape)))
                elif held or block is not None:
                    if block is None:
                        numbers_, values_, limits = zip(*held, strict=True)
                        block = _Block(np.concatenate(numbers_), np.concatenate(values_), k, tuple(np.concatenate(x) for x in zip(*limits, strict=True)))
                        held = []
                    block.meet(values, numbers)
        if block is not None:
            yield block.nearest()

    return run


class _KnnWriter(MLWriter):
    def __init__(self, instance: KnnImputerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"means": self.instance.means})
        self.instance.donors.write.parquet(f"{path}/donors")
        self.instance.boxes.write.parquet(f"{path}/boxes")


class _KnnReader(MLReader):
    def load(self, path: str) -> KnnImputerModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KnnImputerModel(self.sparkSession.read.parquet(f"{path}/donors"), self.sparkSession.read.parquet(f"{path}/boxes"), meta["means"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
