"""Reviewed types, eligibility of samples, thresholds from truth, and what self-training changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.quantiles import column_quantiles

# The types of each level.
LEVELS = {"setting": ("stream", "lake", "slope"), "wetness": ("wet", "dry"), "purity": ("pure", "mixed-water", "mixed-rock")}
#: Decisions that say meadow, as parts of their names, and those that say the contrary.
MEADOW, NOT_MEADOW = ("MEADOW", "PROBABLE", "POSSIBLE", "AUTO", "VERIFIED"), ("NO_MEADOW", "VERIFIED_NO")


def says_meadow(decision: Column) -> Column:
    d = F.upper(F.coalesce(decision, F.lit("")))
    has = lambda words: F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(d, w)), True)
    return ~has(NOT_MEADOW) & has(MEADOW)


def decision_colour(decision: Column) -> Column:
    """The colour of a decision on maps and lists: the first that fits."""
    d, out = F.upper(F.coalesce(decision, F.lit(""))), None
    # Part of a decision's name, and its colour.
    for part, colour in (("AUTO", "#00897B"), ("VERIFIED_YES", "#1B5E20"), ("VERIFIED_NO", "#8E0000"), ("DOUBTFUL", "#E69100"), ("PROBABLE", "#2E7D32"), ("POSSIBLE", "#66BB6A"), ("UNCERTAIN", "#FFB74D")):
        out = F.when(F.contains(d, F.lit(part)), F.lit(colour)) if out is None else out.when(F.contains(d, F.lit(part)), F.lit(colour))
    return out.otherwise(F.lit("#999999"))


def category(levels: list[str], suffix: str = "") -> Column:
    """The class of a point in one level or several together; empty if a part is missing."""
    parts = [F.nullif(F.trim(F.col(x + suffix)), F.lit("")) for x in levels]
    return F.when(F.array_contains(F.array(*[p.isNull() for p in parts]), True), F.lit("")).otherwise(F.concat_ws(" · ", *parts))


def sample_reason(x: Column, y: Column, label: Column, doubtful: Column, reviewed: Column, kind: Column, valid: list[str], decision: Column, with_absence: bool = True, yes_no: bool = False) -> Column:
    """Struct of category, origin and reason of a point as a sample of a level.

    The order of the reasons is part of the rule. With ``yes_no`` the level is meadow or not, whatever the type.
    """
    none = F.lit(None).cast("string")
    made = lambda cat=none, origin=None, why=None: F.struct(cat.alias("category"), F.lit(origin).cast("string").alias("origin"), F.lit(why).cast("string").alias("reason"))
    absence = made(F.lit("absence"), "absence") if with_absence else made(why="absence not included")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    seen, field = F.coalesce(reviewed, F.lit(False)), F.coalesce(label, F.lit(""))
    rule = F.when(~(finite(x) & finite(y)), made(why="no coordinates")).when(seen & (field == "no"), made(why="incoherent")).when(F.coalesce(doubtful, F.lit(False)), made(why="doubtful"))
    if yes_no:
        return rule.when(seen, made(F.lit("meadow"), "review")).when(field == "yes", made(F.lit("meadow"), "field")).when(field == "no", absence).otherwise(made(why="neither yes nor no"))
    return (
        rule.when(seen & kind.isin(*valid), made(kind, "review")).when(seen, made(why="invalid category")).when(field == "no", absence)
        .when((field == "yes") | says_meadow(decision), made(why="type not reviewed")).otherwise(made(why="no label")))


def apply_types(rows: DataFrame, levels: dict[str, tuple[str, ...]] = LEVELS, decision: str = "decision", reviewed: str = "reviewed") -> DataFrame:
    """Types of all points, without touching what a person reviewed.

    ``<level>`` has the present value, ``<level>_proposed`` the rule's. Points that are reviewed or decided as meadow have
    types, all others none. A review with a value that a level does not know counts no longer and is told in ``invalid``.
    """
    bad = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.col(x).isin(*valid), F.lit(False)), F.concat_ws("=", F.lit(x), F.coalesce(F.col(x), F.lit("")))) for x, valid in levels.items()])), "; ")
    rows = rows.withColumn("_claimed", F.coalesce(F.col(reviewed), F.lit(False))).withColumn("invalid", F.when(F.col("_claimed") & (bad != ""), bad))
    rows = rows.withColumn(reviewed, F.col("_claimed") & F.col("invalid").isNull())
    member = F.col(reviewed) | says_meadow(F.col(decision))
    changed = {f"{x}_rule": F.when(member, F.col(f"{x}_proposed")).otherwise(F.lit("")) for x in levels}
    changed |= {x: F.when(F.col(reviewed), F.col(x)).when(member, F.col(f"{x}_proposed")).otherwise(F.lit("")) for x in levels}
    return rows.withColumns(changed).drop("_claimed")


def set_review(rows: DataFrame, chosen: DataFrame, key: str, levels: dict[str, tuple[str, ...]] = LEVELS) -> DataFrame:
    """Record reviews (``key`` and new levels, null to keep) on all chosen rows or, if one of them would stay without a
    valid value in a level, on none: then ValueError."""
    met = rows.join(chosen.select(key, *[F.col(x).alias(f"_{x}") for x in levels], F.lit(True).alias("_chosen")), key, "left")
    new = met.withColumns({f"_{x}": F.coalesce(f"_{x}", F.col(x)) for x in levels})
    wrong = F.lit(False)
    for x, valid in levels.items():
        wrong = wrong | ~F.coalesce(F.col(f"_{x}").isin(*valid), F.lit(False))
    if n := new.where(F.col("_chosen") & wrong).count():
        raise ValueError(f"{n} of the chosen rows have no valid value in some level")
    out = {x: F.when(F.col("_chosen"), F.col(f"_{x}")).otherwise(F.col(x)) for x in levels} | {"reviewed": F.coalesce(F.col("_chosen"), F.col("reviewed"), F.lit(False))}
    return new.withColumns(out).select(*rows.columns)


def clear_review(rows: DataFrame, levels: dict[str, tuple[str, ...]] = LEVELS) -> DataFrame:
    """Back to what the rule proposed."""
    return rows.withColumns({x: F.col(f"{x}_rule") for x in levels} | {"reviewed": F.lit(False)})


def threshold_from_truth(rows: DataFrame, truth: str, score: str, low: float = 0.30, high: float = 0.80, recall: float = 0.90, least: int = 5) -> DataFrame:
    """One row: the cut of the largest Youden index over scores at three decimals (the lowest of equals); with too few
    negatives the score that keeps ``recall`` of the positives; null with too few positives. Kept within low and high."""
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(truth).isin(0, 1)).select(F.col(truth).alias("t"), F.col(score).alias("s"))
    thousandth = lambda x: x.cast("long").alias("k")
    counts = known.groupBy(thousandth(F.floor(F.round(F.col("s") * 1000, 6)))).agg(F.count_if(F.col("t") == 1).alias("pos"), F.count_if(F.col("t") == 0).alias("neg"))
    cuts = known.select(thousandth(F.round(F.col("s") * 1000))).distinct().withColumn("cut", F.lit(True))
    down = Window.orderBy(F.desc("k"))  # a probability has at most 1001 of them
    table = counts.join(cuts, "k", "full").select("k", "cut", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    table = table.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "p": F.sum("pos").over(Window.partitionBy()), "n": F.sum("neg").over(Window.partitionBy())})
    j = F.round(F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")) - F.try_divide(F.col("fp").cast("double"), F.col("n").cast("double")), 9)
    best = table.where("cut").agg(F.min_by("k", F.struct(-j, F.col("k"))).alias("k"), F.max("p").alias("p"), F.max("n").alias("n"))
    kept = column_quantiles(known.where("t = 1"), {"kept": ("s", 1 - recall)})
    value = F.when(F.coalesce("p", F.lit(0)) < least, F.lit(None).cast("double")).when(F.col("n") >= least, F.col("k") / 1000).otherwise(F.col("kept"))
    held = F.least(F.greatest(F.col("value"), F.lit(low)), F.lit(high))
    return best.crossJoin(F.broadcast(kept)).select(value.alias("value")).select(F.when(F.col("value").isNotNull(), held).alias("threshold"))  # one row each


def purity_agreement(rows: DataFrame, purity: str, green: str, none: float, full: float, cut: float) -> DataFrame:
    """Reviewed purity against pure or mixed by the share of green."""
    out = F.when(green_share(F.col(green), none, full) >= F.lit(cut).cast("float"), F.lit("pure")).otherwise(F.lit("mixed"))
    return rows.where(F.col(purity).isin(*LEVELS["purity"]) & F.col(green).isNotNull()).groupBy(purity, out.alias("by_green")).agg(F.count(F.lit(1)).alias("n"))


def green_share(ndvi: Column, none: float, full: float) -> Column:
    """Share of green of a pixel between the index without and with full green, as float."""
    return F.least(F.greatest(((ndvi.cast("float") - F.lit(none).cast("float")) / F.lit(full - none).cast("float")).cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))


def patch_pattern(green: Column, n_patches: Column, mean_patch: Column, largest: Column, opened: Column) -> Column:
    """Signature of an image patch: from the share of green, its components, and what an opening leaves."""
    within = lambda x, lo, hi: F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    shrub = 100 * (0.30 * within(n_patches, 5, 60) + 0.25 * (1 - within(mean_patch, 5, 200)) + 0.20 * (1 - within(largest, 0.2, 0.8)) + 0.25 * (1 - within(opened, 0.2, 0.8)))
    return (F.when(green < 0.02, F.lit("ROCK")).when((opened >= 0.55) & (largest >= 0.40) & (green >= 0.08), F.lit("MEADOW"))
            .when(shrub >= 55, F.lit("SHRUB")).when(green < 0.05, F.lit("ROCK")).otherwise(F.lit("MIXED")))


def origins(rows: DataFrame, base: DataFrame, positives: DataFrame) -> DataFrame:
    """``origin`` and ``decision`` after a round of self-training: doubtful, verified, automatic or predicted.

    ``rows`` has id, label, doubtful and decision; ``base`` and ``positives`` have id.
    """
    met = rows.join(base.select("id", F.lit(True).alias("_base")).distinct(), "id", "left").join(positives.select("id", F.lit(True).alias("_pos")).distinct(), "id", "left")
    human = F.coalesce(F.col("doubtful"), F.lit(False)) | (F.col("label") == "no")
    origin = (F.when(F.coalesce(F.col("doubtful"), F.lit(False)), F.lit("doubtful")).when(F.col("label") == "no", F.lit("verified"))
              .when(F.col("_base"), F.lit("verified")).when(F.col("_pos"), F.lit("auto")).otherwise(F.lit("predicted")))
    decision = F.when(F.coalesce(human, F.lit(False)), F.col("decision")).when(F.col("_base"), F.lit("VERIFIED_YES")).when(F.col("_pos"), F.lit("AUTO")).otherwise(F.col("decision"))
    return met.withColumns({"origin": origin, "decision": decision}).drop("_base", "_pos")
