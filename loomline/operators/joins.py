"""Joins with a rule for repeated or missing partners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs up to which scored pairs are formed where they could be avoided.
FEW_PAIRS = 2_000_000


def one_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order, by a struct minimum (partial on the map side, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*keys, *(F.col(f"__first.{c}").alias(c) for c in rest))


def last_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest))


def last_wins_join(left: DataFrame, right: DataFrame, on: list[str], *order: Column, how: str = "left") -> DataFrame:
    """Equi join with the last of the right rows of each key."""
    return left.join(last_per_key(right, on, *order), on, how)


def priority_join(left: DataFrame, right: DataFrame, left_keys: list[Column], right_keys: list[Column], left_id: str, right_id: str) -> DataFrame:
    """``left`` with the smallest right row that shares the earliest key of the list: (left_id, right_id, key number); each side's keys are exploded, so this is one equi join."""

    def spread(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
        entries = F.array(*(F.struct(F.lit(i).alias("n"), k.cast("string").alias("k")) for i, k in enumerate(keys)))
        return df.select(name, F.explode(entries).alias("e")).select(name, "e.n", "e.k").where("k is not null and k <> ''")

    known = spread(right, right_keys, right_id).groupBy("n", "k").agg(F.min(right_id).alias(right_id))  # one row for each key, however many share it
    pairs = spread(left, left_keys, left_id).join(known, ["n", "k"])
    best = pairs.groupBy(left_id).agg(F.min(F.struct("n", right_id)).alias("b"))
    return left.join(best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.n").alias("key_number")), left_id, "left")


def best_match(pairs: DataFrame, left: str, right: str, score: str, *ties: Column, least: float, delta: float) -> DataFrame:
    """Of scored candidate pairs: left, right, score and status (matched, or ambiguous if another is within ``delta``) of the best."""
    good = pairs.where(F.col(score) >= least)
    w = Window.partitionBy(left)
    ranked = good.withColumn("__n", F.row_number().over(w.orderBy(F.desc(score), *ties)))
    ranked = ranked.withColumn("__close", F.sum((F.max(score).over(w) - F.col(score) <= delta + 1e-12).cast("long")).over(w))
    return ranked.where("__n = 1").select(left, right, score, F.col("__close").alias("candidates"), F.when(F.col("__close") > 1, "ambiguous").otherwise("matched").alias("status"))


def nearness(x: Column, y: Column, scale: float, digits: int) -> Column:
    """1 for equal numbers, less by 1 for a difference of ``scale``; halves of the last digit are rounded away from zero in binary."""
    return F.round((1 - F.abs(x - y) / scale) * 10.0**digits) / 10.0**digits


def nearest_match(left: DataFrame, right: DataFrame, scale: float, digits: int, least: float, delta: float) -> DataFrame:
    """``best_match`` of the pairs of left (a, k, x) and right (b, k, y) rows of one key ``k``, scored by ``nearness`` of x and y, ties to the smaller b, without forming the pairs.

    The score falls with the distance on either side of x.  Right rows collapse to different numbers, these to cells as wide as the last digit of the
    score, and cells to nodes of 2, 4, 8, ... cells.  The nodes beside a cell, one of each size on either side, hold the nearest numbers outside it; the rows that are close to
    the best are those of some nodes and of a few cells at the ends, whose numbers are scored one by one.  All are equi joins on key and node, so that a key with many
    rows is spread.  Keys with a number that is not finite (or beyond 10 ** 12 cells) form their pairs, and so do tables with up to ``FEW_PAIRS`` of them.
    """
    step = scale / 10.0**digits
    left, right = left.where("a is not null and k is not null and x is not null"), right.where("k is not null and y is not null")
    regular = lambda c: F.abs(F.col(c)) < step * 1e12
    by_pairs = lambda rows: best_match(rows.join(right, "k").select("a", "b", nearness(F.col("x"), F.col("y"), scale, digits).alias("score")), "a", "b", "score", F.col("b").asc_nulls_last(), least=least, delta=delta)
    sizes = left.groupBy("k").agg(F.count("*").cast("double").alias("n")).join(right.groupBy("k").agg(F.count("*").alias("m")), "k")
    if (sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) <= FEW_PAIRS:
        return by_pairs(left)
    odd = left.where(~regular("x")).select("k").union(right.where(~regular("y")).select("k")).distinct()
    odd_a = left.join(odd, "k", "left_semi").select("a").distinct()
    rest = by_pairs(left.join(odd_a, "a", "left_semi"))

    left = left.join(odd_a, "a", "left_anti")
    cell = lambda c: F.floor(c / step).cast("long")
    score = nearness(F.col("x"), F.col("y"), scale, digits)
    levels = F.sequence(F.lit(0), F.lit((int(2 * (1 - least) * 10**digits) + 8).bit_length()))
    up = lambda c, level: F.call_function("shiftright", c, level)
    numbers = right.where(regular("y")).groupBy("k", "y").agg(F.count("*").alias("n"), F.min("b").alias("b")).withColumn("cell", cell(F.col("y")))
    nodes = numbers.groupBy("k", "cell").agg(F.sum("n").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))
    nodes = nodes.withColumn("level", F.explode(levels)).groupBy("k", "level", up(F.col("cell"), F.col("level")).alias("node"))
    nodes = nodes.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    # the best score of every different x
    values = left.select("k", "x").distinct().withColumn("cell", cell(F.col("x")))
    beside = values.select("k", "cell").distinct().withColumn("level", F.explode(levels)).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    beside = beside.withColumn("node", up(F.col("cell"), F.col("level")) + F.col("side")).join(nodes, ["k", "level", "node"])
    beside = beside.groupBy("k", "cell").agg(F.max(F.when(F.col("side") < 0, F.col("high"))).alias("before"), F.min(F.when(F.col("side") > 0, F.col("low"))).alias("behind"))
    near = values.join(beside, ["k", "cell"]).select("k", "x", F.explode(F.array("before", "behind")).alias("y")).unionByName(values.join(numbers, ["k", "cell"]).select("k", "x", "y"))
    near = near.where("y is not null").groupBy("k", "x").agg(F.max(score).alias("score")).where(F.col("score") >= least)

    # rows that share an ``a`` have one best score
    rows = left.join(near, ["k", "x"])
    rows = left.join(rows.groupBy("a").agg(F.max("score").alias("best")), "a")
    within = F.least((1 - F.col("best") + delta) * scale, F.lit((1 - least) * scale))  # sure to be close; one step farther, sure not to be
    asked = rows.select("k", "x", "best").distinct().withColumns({"inner": within, "gap": (1 - F.col("best")) * scale})
    asked = asked.withColumns({"first": F.ceil((F.col("x") - F.col("inner")) / step).cast("long"), "last": cell(F.col("x") + F.col("inner")) - 1})
    cells_of = lambda a, b: F.sequence(cell(F.col("x") + a), cell(F.col("x") + b))
    gap, inner, wide = F.col("gap"), F.col("inner"), 1.5 * step
    ends = F.concat(cells_of(-gap - wide, -gap + wide), cells_of(gap - wide, gap + wide), cells_of(-inner - wide, -inner + wide), cells_of(inner - wide, inner + wide))
    singles = asked.withColumn("cell", F.explode(F.array_distinct(ends))).join(numbers, ["k", "cell"]).withColumn("score", score)
    close = (F.col("best") - F.col("score") <= delta + 1e-12) & (F.col("score") >= least) & ~F.col("cell").between(F.col("first"), F.col("last"))
    singles = singles.select("k", "x", "best", F.when(F.col("score") == F.col("best"), F.col("b")).alias("b"), F.when(close, F.col("n")).otherwise(0).alias("n"))

    def cover(level: Column) -> Column:
        """Nodes of a level that belong to the least number of nodes that make up the cells from first to last."""
        a, z = -up(-F.col("first"), level), up(F.col("last") + 1, level)
        node = lambda c: F.struct(level.alias("level"), c.alias("node"))
        return F.array_compact(F.array(F.when((a < z) & (a.bitwiseAND(F.lit(1)) == 1), node(a)), F.when((a < z) & (z.bitwiseAND(F.lit(1)) == 1), node(z - 1))))

    whole = asked.select("k", "x", "best", F.explode(F.flatten(F.transform(levels, cover))).alias("c")).select("k", "x", "best", "c.level", "c.node")
    whole = whole.join(nodes.select("k", "level", "node", "n"), ["k", "level", "node"]).select("k", "x", "best", F.lit(None).cast(right.schema["b"].dataType).alias("b"), "n")
    found = singles.unionByName(whole).groupBy("k", "x", "best").agg(F.min("b").alias("b"), F.sum("n").alias("n"))
    out = rows.join(found, ["k", "x", "best"]).groupBy("a").agg(F.min("b").alias("b"), F.max("best").alias("score"), F.sum("n").alias("candidates"))
    return out.withColumn("status", F.when(F.col("candidates") > 1, "ambiguous").otherwise("matched")).unionByName(rest)


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points within [start, end] of a span: an equi join on cells of ``width``, then the exact test."""
    p = points.withColumn("__cell", F.floor(F.col(at) / width).cast("long"))
    s = spans.where(F.col(start) <= F.col(end)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    return p.join(s, "__cell").where(F.col(at).between(F.col(start), F.col(end))).drop("__cell")


def outer_compare(expected: DataFrame, actual: DataFrame, on: str, checks: dict[str, Column]) -> DataFrame:
    """Full outer join on ``on``: status missing, extra, failed or passed, and the names of the checks that failed.

    ``checks`` are conditions on columns e.* and a.* that hold for a pass.
    """
    j = expected.alias("e").join(actual.alias("a"), F.col(f"e.{on}") == F.col(f"a.{on}"), "full")
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    status = F.when(F.col(f"a.{on}").isNull(), "missing").when(F.col(f"e.{on}").isNull(), "extra").when(F.size(failed) > 0, "failed").otherwise("passed")
    both = F.col(f"a.{on}").isNotNull() & F.col(f"e.{on}").isNotNull()
    return j.select(F.coalesce(f"e.{on}", f"a.{on}").alias(on), status.alias("status"), F.when(both, F.array_join(failed, ",")).otherwise("").alias("failed_checks"))


def prefixes(path: Column) -> Column:
    """All prefixes of a path, itself included."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))


def under_prefix(inner: DataFrame, outer: DataFrame, inner_path: str, outer_path: str) -> DataFrame:
    """Rows of ``inner`` whose path begins with an ``outer`` path: prefixes are exploded and joined by equality."""
    spread = inner.where(F.size(inner_path) > 0).withColumn("__prefix", F.explode(prefixes(F.col(inner_path))))
    return spread.join(outer.withColumnRenamed(outer_path, "__prefix"), "__prefix").withColumnRenamed("__prefix", outer_path)


def hamming_pairs(df: DataFrame, id_: str, bits: str, distance: int) -> DataFrame:
    """Links (a, b, distance) with a < b between rows whose 64-bit values differ in at most ``distance`` bits.

    A value is represented by its smallest id: its other rows are linked to that one (distance 0), and different values to each other through
    theirs, so that a frequent value gives a row each and not a pair of each two.  Of distance + 2 bands two are equal, so an equi join on pairs of
    bands finds every link.
    """
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    band = [F.shiftrightunsigned("bits", cuts[i]).bitwiseAND(F.lit((1 << cuts[i + 1] - cuts[i]) - 1).cast("long")) for i in range(n)]
    rows = df.where(F.col(bits).isNotNull()).select(F.col(id_).alias("id"), F.col(bits).alias("bits"))
    values = rows.groupBy("bits").agg(F.min("id").alias("id"))
    same = rows.join(values.withColumnRenamed("id", "a"), "bits").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    keys = F.array(*(F.struct(F.lit(i * n + j).alias("k"), (F.shiftleft(band[i], 32) + band[j]).alias("v")) for i in range(n) for j in range(i + 1, n)))
    spread = values.select("id", "bits", F.explode(keys).alias("key"))
    a, b = spread.alias("a"), spread.alias("b")
    differ = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))).cast("int")
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (differ <= distance))
    return same.unionByName(near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), differ.alias("distance")).distinct())


def first_violation(claims: DataFrame, limits: DataFrame, keys: list[str], value: str, operator: str, limit: str, per: list[str], *order: Column) -> DataFrame:
    """First claim, in order, that breaks each limit: below a >=, above a <=, different from a ==."""
    v, m, op = F.col(value), F.col(limit), F.col(operator)
    broken = ((op == ">=") & (v < m)) | ((op == "<=") & (v > m)) | ((op == "==") & (v != m))
    return one_per_key(claims.join(limits, keys).where(broken), per, *order)


def perceptual_matches(new: DataFrame, known: DataFrame, distance: int, limit: int) -> DataFrame:
    """id, match, distance: for each new picture (id, sha256, bits) the nearest known ones, ties to the smaller id.

    Pictures of equal bits and equal sha256 are the same file and no match.  Values are compared once, not for every row that has them: pairs of bands
    (two of distance + 2 are equal) name the pairs of values, and a value passes on only its first ``limit`` + 1 rows that may count.
    """
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    band = [F.shiftrightunsigned("bits", cuts[i]).bitwiseAND(F.lit((1 << cuts[i + 1] - cuts[i]) - 1).cast("long")) for i in range(n)]
    keys = F.explode(F.array(*(F.struct(F.lit(i * n + j).alias("k"), (F.shiftleft(band[i], 32) + band[j]).alias("v")) for i in range(n) for j in range(i + 1, n))))
    a = new.where("bits is not null").select("bits").distinct().withColumn("key", keys).alias("a")
    b = known.where("bits is not null").select("bits").distinct().withColumn("key", keys).alias("b")
    apart = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))).cast("int")
    values = a.join(b, (F.col("a.key") == F.col("b.key")) & (apart <= distance)).select(F.col("a.bits").alias("bits"), F.col("b.bits").alias("other"), apart.alias("distance")).distinct()
    # of the rows of one file the first suffices, and of one value ``limit`` files besides the picture's own
    files = known.groupBy(F.col("bits").alias("other"), F.col("sha256").alias("file")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    first = files.select("other", "file", F.explode(F.slice("ids", 1, limit)).alias("match"))
    rank = F.row_number().over(Window.partitionBy("other", "file").orderBy("match"))
    first = first.withColumn("n", rank).where(F.col("n") <= limit).drop("n")
    pairs = new.where("bits is not null").join(values, "bits").join(first, "other").where((F.col("distance") > 0) | ~F.col("file").eqNullSafe(F.col("sha256")))
    best = F.row_number().over(Window.partitionBy("id").orderBy("distance", "match"))
    return pairs.select("id", "match", "distance").withColumn("n", best).where(F.col("n") <= limit).drop("n")
