"""Business questions over plants, units and emissions. Every limit, date and count is a parameter."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import domain

MEASURES = ("so2", "nox", "soot")


def between(ts: str, start: datetime, end: datetime) -> Column:
    """Half-open time range, which reaches the scan as two comparisons."""
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))


def month_range(year: int, month: int | None = None) -> tuple[datetime, datetime]:
    if month is None:
        return datetime(year, 1, 1), datetime(year + 1, 1, 1)
    return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)


def join_facts(so2: DataFrame, nox: DataFrame, soot: DataFrame) -> DataFrame:
    """SO2, NOx and soot of the same unit and stamp; all three arrive clustered on the join key."""
    return so2.join(nox, ["unit_id", "ts"]).join(soot, ["unit_id", "ts"])


def with_unit(facts: DataFrame, units: DataFrame, plants: DataFrame | None = None) -> DataFrame:
    """Facts with unit (and plant) columns. The optimiser broadcasts a side only when its size allows."""
    dims = units.join(plants, "plant_id") if plants is not None else units
    return facts.join(dims, "unit_id")


def units_over_limit(so2, nox, soot, units, plants, *, minutes: bool = False) -> DataFrame:
    """Readings of limited unit types with any pollutant over its limit, newest first."""
    facts = [f if minutes else f.drop("time_2to30", "time_30to50") for f in (so2, nox, soot)]
    if minutes:
        facts = [f.withColumn(f"{m}_minutes", F.col("time_2to30") + F.col("time_30to50")).drop("time_2to30", "time_30to50")
                 for f, m in zip(facts, MEASURES)]
    joined = with_unit(join_facts(*facts), units, plants).filter(domain.exceeds())
    extra = [f"{m}_minutes" for m in MEASURES] if minutes else []
    return joined.select("plant_name", "unit_name", "ts", *MEASURES, domain.emission_status().alias("status"), *extra).orderBy(
        F.desc("ts"), "unit_name")


def emission_intensity(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Total mass per generated kWh and unit, guarded against zero generation."""
    flow = domain.flue_gas_flow(F.col("kwh"), F.col("unit_type"))
    totals = facts.join(units.select("unit_id", "unit_type"), "unit_id").groupBy("unit_id").agg(
        F.sum("kwh").alias("kwh"), *[F.sum(domain.emission_mass(F.col(m), flow, m)).alias(f"{m}_t") for m in MEASURES])
    return totals.select("unit_id", "kwh", *[domain.guarded_ratio(F.col(f"{m}_t"), F.col("kwh")).alias(f"{m}_per_kwh") for m in MEASURES])


def lowest_intensity(facts, units, plants, k: int = 3) -> DataFrame:
    rank = sum((F.col(f"{m}_per_kwh") for m in MEASURES), F.lit(0.0))
    rows = emission_intensity(facts, units).filter(F.col("kwh") > 0)
    return with_unit(rows, units, plants).select(
        "plant_name", "unit_name", *[f"{m}_per_kwh" for m in MEASURES], rank.alias("total_per_kwh"), "unit_id"
    ).orderBy(F.round("total_per_kwh", 9), "unit_id").limit(k).drop("unit_id")


def units_of_area(units: DataFrame, plants: DataFrame, areas: DataFrame, *, parent: str | None = None, area: str | None = None) -> DataFrame:
    """Units of one area or of the children of one parent. The optimiser checks the sizes of the dimensions."""
    picked = areas
    if parent is not None:
        picked = picked.filter(F.col("parent_code") == parent)
    if area is not None:
        picked = picked.filter(F.col("area_name") == area)
    return units.join(plants.join(picked, "area_code"), "plant_id")


def monthly_trend(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Average concentration per calendar month over the given units."""
    return facts.join(units.select("unit_id"), "unit_id").groupBy(F.month("ts").alias("month")).agg(
        *[F.avg(m).alias(m) for m in MEASURES]).orderBy("month")


def month_summary(so2: DataFrame, nox: DataFrame, soot: DataFrame, units: DataFrame) -> DataFrame:
    """Counts of plants and units by type and average readings of one month, units without data included.

    Joining three fact tables on the unit alone multiplies their rows, so the average of one table is
    weighted by the row counts of the others. The weights come from per-unit sums and counts; the
    multiplied rows are never built. ``plain_*`` are the unweighted averages.
    """
    specs = [(so2, {"so2": "so2", "fgd_efficiency": "fgd"}), (nox, {"nox": "nox", "scr_efficiency": "scr"}), (soot, {"soot": "soot"})]
    rows = units
    for i, (facts, cols) in enumerate(specs):
        sums = facts.groupBy("unit_id").agg(F.count("*").alias(f"c{i}"), *[F.sum(c).alias(f"s_{n}") for c, n in cols.items()])
        rows = rows.join(sums, "unit_id", "left")
    rows = rows.withColumns({f"w{i}": F.greatest(F.coalesce(F.col(f"c{i}"), F.lit(0)), F.lit(1)) for i in range(3)})
    every = F.col("w0") * F.col("w1") * F.col("w2")
    aggs = [F.count_distinct("plant_id").alias("plants")]
    for name, kind in (("coal_units", domain.COAL), ("gas_units", domain.GAS), ("wind_units", domain.WIND)):
        aggs.append(F.count_distinct(F.when(F.col("unit_type") == kind, F.col("unit_id"))).alias(name))
    for i, (_, cols) in enumerate(specs):
        others = every / F.col(f"w{i}")
        for n in cols.values():
            aggs.append((F.sum(F.col(f"s_{n}") * others) / F.sum(F.col(f"c{i}") * others)).alias(f"avg_{n}"))
            aggs.append((F.sum(f"s_{n}") / F.sum(f"c{i}")).alias(f"plain_{n}"))
    aggs.append((F.sum(F.col("rating") * every) / F.sum(every)).alias("avg_rating"))
    return rows.agg(*aggs)


def daily_load_by_type(facts: DataFrame, units: DataFrame, types: dict[str, str]) -> DataFrame:
    """Average rating of reporting units per day and type, one column per type.

    Each column is the maximum over the day's types of (rating if it is this type, else 0), as the question's
    SQL has it: 0 where the type is absent, and no lower than 0 where other types report.
    """
    daily = (
        facts.select("unit_id", "ts").join(units.filter(F.col("unit_type").isin(list(types))).select("unit_id", "unit_type", "rating"), "unit_id")
        .groupBy(F.to_date("ts").alias("day"), "unit_type").agg(F.avg("rating").alias("rating"))
    )
    return daily.groupBy("day").agg(*[
        F.max(F.when(F.col("unit_type") == t, F.col("rating")).otherwise(0.0)).alias(n) for t, n in types.items()]).orderBy("day")


def unpivot(facts: DataFrame, keys: Sequence[str] = ("unit_id", "ts"), limits: dict[str, float] = domain.LIMITS) -> DataFrame:
    """keys, pollutant, value, limit."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("pollutant"), F.col(m).alias("value"), F.lit(v).alias("limit")) for m, v in limits.items()])).alias("x")
    return facts.select(*keys, cells).select(*keys, "x.*")


def hourly_average(facts: DataFrame, by: str = "hour", limits: dict[str, float] = domain.LIMITS) -> DataFrame:
    """Average per pollutant and time bucket beside its limit line."""
    bucket = F.date_trunc(by, "ts").cast("timestamp_ntz").alias("bucket")
    return unpivot(facts).groupBy("pollutant", "limit", bucket).agg(F.avg("value").alias("average"), F.count("*").alias("n"))


def unit_table(facts: DataFrame, limits: dict[str, float] = domain.LIMITS) -> DataFrame:
    """Current, average and maximum value, limit and status per unit and pollutant.

    Readings are summed up in one row per unit, and only these rows are unpivoted.
    """
    per_unit = facts.groupBy("unit_id").agg(*[
        F.struct(F.max_by(m, "ts").alias("current"), F.avg(m).alias("average"), F.max(m).alias("maximum")).alias(m) for m in limits])
    rows = unpivot(per_unit, ["unit_id"], limits).select("unit_id", "pollutant", "limit", "value.*")
    return rows.withColumn("status", domain.severity_label(domain.early_warning(F.col("current"), F.col("limit"))))


def state_share(facts: DataFrame, units: DataFrame, *, full_load: float, low: float = 0.5) -> DataFrame:
    """Share of readings per operating state of each unit: normal, low load, maintenance, stopped."""
    ratio = F.col("kwh") / F.lit(full_load)
    state = (
        F.when(F.col("kwh") <= 0, "stopped").when(F.col("active_flag") == 0, "maintenance").when(ratio < low, "low_load").otherwise("normal")
    )
    counts = facts.join(units.select("unit_id", "active_flag"), "unit_id").groupBy("unit_id", state.alias("state")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("unit_id"))
    return counts.withColumn("share", F.col("n") / total)


def exceedances(facts: DataFrame, limits: dict[str, float] = domain.LIMITS) -> DataFrame:
    """Every value over its limit with the excess in percent."""
    return unpivot(facts, limits=limits).filter(F.col("value") > F.col("limit")).withColumn(
        "rate", domain.exceedance_rate(F.col("value"), F.col("limit")))


def exceedance_counts(facts: DataFrame, by: Sequence[str] = ("pollutant",), limits: dict[str, float] = domain.LIMITS) -> DataFrame:
    return exceedances(facts, limits).groupBy(*by).agg(F.count("*").alias("n"), F.max("rate").alias("worst_rate"))


def rank_units(facts: DataFrame, k: int, lowest: bool = True) -> DataFrame:
    """Units by the mean of their average concentrations."""
    avg = facts.groupBy("unit_id").agg(*[F.avg(m).alias(m) for m in MEASURES])
    score = F.round((F.col("so2") + F.col("nox") + F.col("soot")) / 3, 9)
    scored = avg.withColumn("score", score)
    return scored.orderBy(F.asc("score") if lowest else F.desc("score"), "unit_id").limit(k)


def daily_trend(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.to_date("ts").alias("day")).agg(*[F.avg(m).alias(m) for m in MEASURES]).orderBy("day")


def status_board(facts: DataFrame, limits: dict[str, float] = domain.LIMITS) -> DataFrame:
    """Latest reading per unit with a status per pollutant and the worst of them."""
    last = facts.groupBy("unit_id").agg(F.max("ts").alias("ts"), *[F.max_by(m, "ts").alias(m) for m in limits])
    codes = {m: domain.top_line(F.col(m), v) for m, v in limits.items()}
    worst = F.greatest(*codes.values())
    return last.select("unit_id", "ts", *limits, *[domain.severity_label(c).alias(f"{m}_status") for m, c in codes.items()],
                       domain.severity_label(worst).alias("status"))


def list_emissions(
    facts: DataFrame, *, page: int = 1, page_size: int = 10, pollutant: str | None = None, start: datetime | None = None,
    end: datetime | None = None, unit: int | None = None,
) -> DataFrame:
    """One page of readings, oldest first, with paging columns. ``start``/``end`` are whole days, inclusive.

    The page number is clamped to the existing pages; only the page's rows reach the driver's top-k.
    """
    rows = facts
    if unit is not None:
        rows = rows.filter(F.col("unit_id") == unit)
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("ts") < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
    cols = [pollutant] if pollutant else list(MEASURES)
    rows = rows.select("unit_id", "ts", *cols)
    total = rows.count()
    pages = max(1, -(-total // page_size))
    page = min(max(1, page), pages)
    return rows.orderBy("ts", "unit_id").offset((page - 1) * page_size).limit(page_size).select(
        "*", F.lit(page).alias("page"), F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("total_pages"),
        F.lit(page < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def quarter_comparison(facts: DataFrame) -> DataFrame:
    """Quarterly averages with the change against the quarter before."""
    q = facts.groupBy(F.year("ts").alias("year"), F.quarter("ts").alias("quarter")).agg(*[F.avg(m).alias(m) for m in MEASURES])
    w = Window.orderBy("year", "quarter")
    return q.select("*", *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in MEASURES])


def generation_by(facts: DataFrame, units: DataFrame, by: str) -> DataFrame:
    """Generation per group of units: total, average, units reporting and rank."""
    per_unit = facts.groupBy("unit_id").agg(F.sum("kwh").alias("kwh"), F.count("*").alias("n"))
    out = per_unit.join(units.select("unit_id", by), "unit_id").groupBy(by).agg(
        F.sum("kwh").alias("kwh"), (F.sum("kwh") / F.sum("n")).alias("avg_kwh"), F.count("*").alias("units"))
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.round("kwh", 2)))))


def efficiency_by_month(so2: DataFrame, units: DataFrame, efficiency: str = "fgd_efficiency") -> DataFrame:
    return so2.join(units.select("unit_id"), "unit_id").groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(
        F.avg(efficiency).alias("average"), F.min(efficiency).alias("minimum"), F.max(efficiency).alias("maximum"))


def inside_periods(facts: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """Average readings on flagged days against the other days.

    Facts are summed per day before they meet the distinct flagged days.
    """
    daily = facts.groupBy(F.to_date("ts").alias(day)).agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in MEASURES])
    flagged = days.select(F.to_date(day).alias(day)).distinct().withColumn("inside", F.lit(True))
    joined = daily.join(flagged, day, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return joined.groupBy("inside").agg(F.sum("n").alias("n"), *[(F.sum(m) / F.sum("n")).alias(m) for m in MEASURES])


def type_comparison(facts: DataFrame, units: DataFrame, left: str = domain.COAL, right: str = domain.GAS) -> DataFrame:
    """Average readings of two unit types side by side."""
    rows = facts.join(units.select("unit_id", "unit_type"), "unit_id").filter(F.col("unit_type").isin(left, right))
    aggs = []
    for m in MEASURES:
        a, b = (F.avg(F.when(F.col("unit_type") == t, F.col(m))) for t in (left, right))
        aggs += [a.alias(f"{m}_left"), b.alias(f"{m}_right"), (a - b).alias(f"{m}_difference")]
    return rows.agg(*aggs)


def month_on_month(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Monthly total and its change against the month before, absolute and in percent."""
    m = df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")).agg(F.sum(value).alias("total"))
    prev = F.lag("total").over(Window.orderBy("year", "month"))
    return m.select("*", (F.col("total") - prev).alias("change"), (F.try_divide(F.col("total") - prev, prev) * 100).alias("change_pct"))


def quarterly_load(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.year("ts").alias("year"), F.quarter("ts").alias("quarter")).agg(
        F.sum("kwh").alias("kwh"), F.avg("kwh").alias("avg_kwh"), F.max("kwh").alias("peak_kwh"))


def renewable_share(facts: DataFrame, units: DataFrame, renewable: Sequence[str] = (domain.WIND, domain.SOLAR)) -> DataFrame:
    per_unit = facts.groupBy("unit_id").agg(F.sum("kwh").alias("kwh"))
    green = F.sum(F.when(F.col("unit_type").isin(*renewable), F.col("kwh")).otherwise(0.0))
    return per_unit.join(units.select("unit_id", "unit_type"), "unit_id").agg(
        green.alias("renewable_kwh"), F.sum("kwh").alias("kwh"), domain.guarded_ratio(green, F.sum("kwh")).alias("share"))


def before_after(facts: DataFrame, date: datetime) -> DataFrame:
    """Average readings before and from a date, and the difference."""
    late = F.col("ts") >= F.lit(date).cast("timestamp_ntz")
    aggs = []
    for m in MEASURES:
        a, b = F.avg(F.when(~late, F.col(m))), F.avg(F.when(late, F.col(m)))
        aggs += [a.alias(f"{m}_before"), b.alias(f"{m}_after"), (b - a).alias(f"{m}_difference")]
    return facts.agg(*aggs)
