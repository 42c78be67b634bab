"""Sample coverage C5-C9 (Nagappan et al., "Diversity in software
engineering research"): the share of a universe of projects that is similar
to at least one project of a sample, in every dimension.

Similarity per dimension (C9 spec ``{name: kind}``):

* ``"band"``  numeric: |log10(u + 1) - log10(s + 1)| <= 0.5 (half a decade);
* ``"sd"``    numeric: |u - s| <= sample standard deviation of the universe;
* ``"equal"`` factor: u = s.

A NULL value is never similar (the row stays in the denominator).

No pair of rows is formed. A numeric dimension is cut into cells as wide as its
band (or standard deviation), so two values of one cell are similar for sure,
and a value of the next cell is similar if the cell's nearest value is. The
sample is therefore reduced to its *reach*: per factor values, cell and
direction of the neighbour the nearest value (two dimensions that both differ:
the nearest second value per first value). The universe meets the reach on factor
values and cells only. Numeric dimensions beyond the second are compared value
by value inside the cells.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BAND = 0.5  # half a decade on the log10(v + 1) scale


class SchemaError(ValueError):
    """Raised when a dimension is missing from an input."""


def check_columns(universe: DataFrame, sample: DataFrame, dims: dict) -> None:
    """Every dimension must exist in both inputs and have a known kind."""
    for d, kind in dims.items():
        if d not in universe.columns or d not in sample.columns:
            raise SchemaError(f"dimension {d} missing from an input")
        if kind not in ("band", "sd", "equal"):
            raise SchemaError(f"unknown similarity {kind} for {d}")


def _lg(c: Column) -> Column:
    return F.log10(c + 1)


class Grid:
    """How each dimension is compared: factors by value, numeric ones on a
    scale of cells ``width`` wide. A zero standard deviation leaves only equal
    values similar; without one (fewer than two rows) nothing is."""

    def __init__(self, universe: DataFrame, dims: dict):
        sd_dims = [d for d, k in dims.items() if k == "sd"]
        row = universe.agg(*[F.stddev_samp(d).alias(d) for d in sd_dims]).first() if sd_dims else {}
        self.width = {d: BAND for d, k in dims.items() if k == "band"} | {d: row[d] for d in sd_dims if row[d] != 0}
        self.dims = dims
        self.factors = [d for d in dims if d not in self.width]
        self.numeric = list(self.width)

    def scale(self, d: str, value: Column) -> Column:
        return _lg(value) if self.dims[d] == "band" else value.cast("double")

    def cell(self, d: str, value: Column) -> Column:
        return F.floor(self.scale(d, value) / F.lit(self.width[d])).cast("long")

    def near(self, d: str, a: Column, b: Column) -> Column:
        return F.abs(self.scale(d, a) - self.scale(d, b)) <= F.lit(self.width[d])

    def placed(self, df: DataFrame, key: str, prefix: str) -> DataFrame:
        """``key`` and per dimension its factor value or its scale value and
        (for the first two numeric ones) its cell, under prefixed names."""
        cols = [F.col(key).alias(prefix + "key")] + [F.col(d).alias(prefix + d) for d in self.factors]
        cols += [self.scale(d, F.col(d)).alias(prefix + d) for d in self.numeric]
        cols += [self.cell(d, F.col(d)).alias(f"{prefix}cell{i}") for i, d in enumerate(self.numeric[:2])]
        return df.select(*cols)

    def around(self, placed: DataFrame, prefix: str) -> DataFrame:
        """A row per cell that the row may reach, with its directions ``to0``,
        ``to1`` (the row lies that many cells away)."""
        n = len(self.numeric[:2])
        steps = F.array(*[F.struct(*[F.lit(x).alias(f"to{i}") for i, x in enumerate(t)])
                          for t in product((-1, 0, 1), repeat=n)]) if n else None
        if not n:
            return placed
        out = placed.withColumn("_to", F.explode(steps))
        for i in range(n):
            out = out.withColumn(f"to{i}", F.col(f"_to.to{i}")) \
                .withColumn(f"{prefix}cell{i}", F.col(f"{prefix}cell{i}") - F.col(f"_to.to{i}"))
        return out.drop("_to")

    def slot(self, a: str, b: str) -> Column:
        """Same factor values and cells."""
        names = [*self.factors, *[f"cell{i}" for i in range(len(self.numeric[:2]))]]
        return reduce(lambda x, y: x & y, [F.col(a + n) == F.col(b + n) for n in names])

    def reach(self, sample: DataFrame) -> DataFrame:
        """The sample's reach: slots (``s_``), directions, the values that
        must be compared and the nearest value in the last direction."""
        key = next(iter(self.dims))
        rows = self.around(self.placed(sample, key, "s_"), "s_")
        grid, more = self.numeric[:2], self.numeric[2:]
        toward = [F.when(F.col(f"to{i}") != 0, F.col(f"to{i}") * F.col("s_" + d)) for i, d in enumerate(grid)]
        last = F.coalesce(*reversed(toward)) if toward else F.lit(None).cast("double")
        first = F.when((F.col("to0") != 0) & (F.col("to1") != 0), toward[0]) if len(grid) == 2 else F.lit(None).cast("double")
        by = ["s_" + d for d in [*self.factors, *more]] + [x for i in range(len(grid)) for x in (f"s_cell{i}", f"to{i}")]
        return rows.select(*by, first.alias("_first"), last.alias("_last")).groupBy(*by, "_first") \
            .agg(F.min("_last").alias("_last"))

    def reached(self) -> Column:
        """Whether a placed row (``u_``) lies within a row of the reach of its slot."""
        out = F.lit(True)
        for i, d in enumerate(self.numeric[:2]):
            ahead = F.col(f"to{i}") * F.col("u_" + d)
            other = F.col(f"to{1 - i}") != 0 if len(self.numeric) > 1 else F.lit(False)
            value = F.when(other, F.col("_first")).otherwise(F.col("_last")) if i == 0 else F.col("_last")
            out = out & ((F.col(f"to{i}") == 0) | (value - ahead <= F.lit(self.width[d])))
        for d in self.numeric[2:]:
            out = out & (F.abs(F.col("u_" + d) - F.col("s_" + d)) <= F.lit(self.width[d]))
        return out


def covered(universe: DataFrame, sample: DataFrame, dims: dict, key: str = "repository",
            grid: Grid | None = None) -> DataFrame:
    """``key`` of the universe rows similar in all ``dims`` to at least
    one sample row: a semi join on factor values and cells with the sample's
    reach."""
    check_columns(universe, sample, dims)
    grid = grid or Grid(universe, dims)
    rows = grid.placed(universe, key, "u_")
    return rows.join(grid.reach(sample), grid.slot("u_", "s_") & grid.reached(), "left_semi") \
        .select(F.col("u_key").alias(key))


def coverage_score(universe: DataFrame, sample: DataFrame, dims: dict,
                   key: str = "repository") -> DataFrame:
    """Covered universe rows / all universe rows (one row)."""
    n = universe.agg(F.count("*")).scalar()
    c = covered(universe, sample, dims, key).agg(F.count("*").alias("covered"))
    return c.select("covered", n.alias("universe"), F.round(F.try_divide(F.col("covered"), n), 6).alias("score"))


def coverage_by_dimension(universe: DataFrame, sample: DataFrame, dims: dict,
                          key: str = "repository") -> DataFrame:
    """The score of each dimension alone (one row per dimension), in one
    pass over either table: a row per dimension with its slot (factor value or
    cell), and per slot of the sample whether it is taken and the nearest values
    of its neighbours."""
    check_columns(universe, sample, dims)
    grid = Grid(universe, dims)

    def rows(df: DataFrame) -> DataFrame:
        parts = []
        for d in dims:
            number = d in grid.width
            slot = grid.cell(d, F.col(d)) if number else F.col(d)
            x = grid.scale(d, F.col(d)) if number else F.lit(None)
            parts.append(F.struct(F.lit(d).alias("dimension"), slot.cast("string").alias("slot"),
                                  x.cast("double").alias("x"), F.lit(number).alias("number"),
                                  F.lit(grid.width.get(d)).cast("double").alias("width")))
        return df.select(F.inline(F.array(*parts)))

    # a value reaches its own cell and both neighbours
    near = rows(sample).where("slot IS NOT NULL").withColumn("to", F.explode(F.expr(
        "CASE WHEN number THEN array(-1, 0, 1) ELSE array(0) END")))
    near = near.groupBy("dimension", F.expr("CASE WHEN number THEN string(bigint(slot) - to) ELSE slot END").alias("slot")).agg(
        F.bool_or(F.col("to") == 0).alias("own"), F.min(F.when(F.col("to") == 1, F.col("x"))).alias("above"),
        F.max(F.when(F.col("to") == -1, F.col("x"))).alias("below"))
    hit = F.coalesce("own", F.lit(False)) | F.coalesce(F.col("above") - F.col("x") <= F.col("width"), F.lit(False)) | \
        F.coalesce(F.col("x") - F.col("below") <= F.col("width"), F.lit(False))
    return rows(universe).join(near, ["dimension", "slot"], "left").groupBy("dimension").agg(
        F.round(F.try_divide(F.count_if(hit), F.count("*")), 6).alias("score"))


def coverage_inputs(universe: DataFrame, ours: DataFrame, where: Column, dims: list[str],
                    key: str = "repository") -> tuple[DataFrame, DataFrame]:
    """The universe restricted by ``where`` to the key and the dimensions;
    the sample = universe rows whose key is one of ``ours``."""
    u = universe.where(where).select(key, *dims)
    return u, u.join(ours.select(key), key, "left_semi")


# leaders of the gain order that are evaluated at once
LEADERS = 256


def coverage_next(universe: DataFrame, sample: DataFrame, dims: dict, steps: int,
                  key: str = "repository", leaders: int = LEADERS) -> DataFrame:
    """Greedily add the universe row that covers most still uncovered
    universe rows (ties: smallest key), ``steps`` times or until no row can add
    any. Output (step, added, newly_covered, score).

    Rows with equal values are one profile with a weight. A profile's gain is at
    most the uncovered weight in the cells around it (a sum over cells, no
    pairs) and never grows as rows get covered, so an earlier gain bounds
    a later one. Each step takes the ``leaders`` largest bounds and evaluates
    those that are out of date against the uncovered profiles of their cells,
    until the first of the order is up to date: no other profile can beat it.
    Only the leaders of a step reach the driver.
    """
    spark = universe.sparkSession
    check_columns(universe, sample, dims)
    grid = Grid(universe, dims)
    whole = reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in dims])
    n = universe.count()
    profiles = cut_lineage(universe.where(whole).groupBy(*dims).agg(F.min(key).alias("id"), F.count("*").alias("w")))
    placed = grid.placed(profiles, "id", "p_").join(profiles.select(F.col("id").alias("p_key"), "w"), "p_key")
    is_open = covered(profiles, sample, dims, "id", grid)
    uncovered = cut_lineage(placed.join(is_open.select(F.col("id").alias("p_key")), "p_key", "left_anti"))
    n_open = n - _weight(placed) + _weight(uncovered)  # rows with a null are never covered
    slots = [*grid.factors, *[f"cell{i}" for i in range(len(grid.numeric[:2]))]]
    # every profile's bound, from the weight of the cells around it
    cells = grid.around(uncovered, "p_").groupBy(*["p_" + c for c in slots]).agg(F.sum("w").alias("bound"))
    bounds = cut_lineage(placed.join(cells, ["p_" + c for c in slots]).select("p_key", "bound"))
    gains = spark.createDataFrame([], "p_key long, gain long, at int")
    rows = []
    for step in range(1, steps + 1):
        while True:
            order = bounds.join(gains, "p_key", "left").select(
                "p_key", F.coalesce("gain", "bound").alias("bound"), F.coalesce("at", F.lit(0)).alias("at")) \
                .orderBy(F.desc("bound"), "p_key").limit(leaders).collect()
            if not order or order[0]["bound"] == 0 or order[0]["at"] == step:
                break
            stale = [r["p_key"] for r in order[:next((i for i, r in enumerate(order) if r["at"] == step), len(order))]]
            asked = placed.where(F.col("p_key").isin(stale)).drop("w")
            found = _near_profiles(asked, uncovered, grid).groupBy("p_key").agg(F.sum("w").alias("gain"))
            now = asked.select("p_key").join(found, "p_key", "left").select(
                "p_key", F.coalesce("gain", F.lit(0)).alias("gain"), F.lit(step).alias("at"))
            gains = cut_lineage(gains.where(~F.col("p_key").isin(stale)).unionByName(now))
        if not order or order[0]["bound"] == 0:
            break
        pick = placed.where(F.col("p_key") == F.lit(order[0]["p_key"])).drop("w")
        gone = _near_profiles(pick, uncovered, grid).select(F.col("o_key").alias("p_key"))
        uncovered = cut_lineage(uncovered.join(gone, "p_key", "left_anti"))
        n_open -= order[0]["bound"]
        rows.append((step, order[0]["p_key"], order[0]["bound"], round((n - n_open) / n, 6)))
    return spark.createDataFrame(rows, "step int, added long, newly_covered long, score double")


def _weight(placed: DataFrame) -> int:
    return placed.agg(F.sum("w")).first()[0] or 0


def _near_profiles(asked: DataFrame, others: DataFrame, grid: Grid) -> DataFrame:
    """(p_key, o_key, w): uncovered profiles similar to each of a bounded
    number of profiles, which are looked up in the cells around them."""
    around = grid.around(asked, "p_")
    o = others.select(*[F.col(c).alias("o_" + c[2:]) for c in others.columns if c.startswith("p_")], "w")
    near = reduce(lambda a, b: a & b, [F.abs(F.col("p_" + d) - F.col("o_" + d)) <= F.lit(grid.width[d])
                                       for d in grid.numeric], F.lit(True))
    return around.join(o, grid.slot("p_", "o_") & near).select("p_key", "o_key", "w")
