"""Domain constants. Labels and limits are parameters everywhere; these are only the defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit types, status labels and impact label as they appear in the data.
COAL, GAS, WIND, SOLAR = "燃煤机", "燃气机", "风电", "光电"
OVER, NORMAL, UNKNOWN = "超标", "正常", "未知"
HIGH_IMPACT = "高"

# Emission limits in mg/m3; soot is 5 in the relational layer and 10 on the dashboard.
LIMITS = {"so2": 35.0, "nox": 50.0, "soot": 5.0}
DASHBOARD_LIMITS = {"so2": 35.0, "nox": 50.0, "dust": 10.0}
LIMITED_TYPES = (COAL, GAS)

# Flue-gas flow per kWh by unit type, and mass factor per pollutant.
FLOW_PER_KWH = {COAL: 12.0, GAS: 8.0}
MASS_FACTOR = {"so2": 0.01, "nox": 0.01, "soot": 0.001}


def any_over(limits: dict[str, float] = LIMITS) -> Column:
    """True when any pollutant column exceeds its limit."""
    tests = [F.col(c) > F.lit(v) for c, v in limits.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def exceeds(unit_type: str = "unit_type", limits_by_type: dict[str, dict[str, float]] | None = None) -> Column:
    """OR over unit types of (type matches AND any pollutant over that type's limit)."""
    table = limits_by_type or {t: LIMITS for t in LIMITED_TYPES}
    out = F.lit(False)
    for kind, limits in table.items():
        out = out | ((F.col(unit_type) == kind) & any_over(limits))
    return out


def emission_status(unit_type: str = "unit_type", limits_by_type: dict[str, dict[str, float]] | None = None) -> Column:
    """Label a reading: over limit, normal, or unknown when the unit type has no limits."""
    table = limits_by_type or {t: LIMITS for t in LIMITED_TYPES}
    out = None
    for kind, limits in table.items():
        label = F.when(any_over(limits), OVER).otherwise(NORMAL)
        hit = F.col(unit_type) == kind
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(UNKNOWN)


def severity(value: Column, limit: float | Column, danger: float, warning: float) -> Column:
    """0 normal, 1 warning, 2 danger: above ``danger``/``warning`` multiples of the limit."""
    lim = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.when(value > lim * F.lit(danger), 2).when(value > lim * F.lit(warning), 1).otherwise(0)


def top_line(value: Column, limit: float | Column) -> Column:
    """Dashboard classifier: danger above 1.2 x limit, warning above the limit."""
    return severity(value, limit, 1.2, 1.0)


def early_warning(value: Column, limit: float | Column) -> Column:
    """Forecast-page classifier: danger above the limit, warning above 0.8 x limit."""
    return severity(value, limit, 1.0, 0.8)


def severity_label(code: Column) -> Column:
    return F.when(code == 2, "danger").when(code == 1, "warning").otherwise("normal")


def over_multiple(value: Column, limit: float | Column) -> Column:
    """value / limit - 1, null when the reading is not above zero excess."""
    lim = limit if isinstance(limit, Column) else F.lit(float(limit))
    m = value / lim - F.lit(1.0)
    return F.when(m > 0, m)


def severity_band(multiple: Column, threshold: float = 0.3) -> Column:
    """Band of an exceedance: below or from ``threshold`` times over."""
    return F.when(multiple.isNull(), None).when(multiple < threshold, "2to30").otherwise("30to50")


def exceedance_rate(value: Column, limit: float | Column) -> Column:
    """Excess over the limit in percent."""
    lim = limit if isinstance(limit, Column) else F.lit(float(limit))
    return (value - lim) / lim * F.lit(100.0)


def flue_gas_flow(kwh: Column, unit_type: Column) -> Column:
    """Flow proportional to generation; coal has its own factor, every other type the gas one."""
    return kwh * F.when(unit_type == COAL, FLOW_PER_KWH[COAL]).otherwise(FLOW_PER_KWH[GAS])


def emission_mass(concentration: Column, flow: Column, pollutant: str) -> Column:
    return concentration * flow * F.lit(MASS_FACTOR[pollutant])


# Linear scoring coefficients (intercept, three slopes) and clamp range per pollutant.
SCORE = {
    "so2": ((20.0, 0.1, 0.05, -0.03), (5.0, 50.0)),
    "nox": ((40.0, 0.15, 0.08, -0.05), (10.0, 70.0)),
    "dust": ((8.0, 0.05, 0.02, -0.01), (2.0, 15.0)),
}


def linear_score(pollutant: str, a: Column, b: Column, c: Column) -> Column:
    """Deterministic part of the linear emission score, clamped to the pollutant's range."""
    (k0, ka, kb, kc), (lo, hi) = SCORE[pollutant]
    raw = F.lit(k0) + F.lit(ka) * a + F.lit(kb) * b + F.lit(kc) * c
    return F.greatest(F.lit(lo), F.least(F.lit(hi), raw))


def guarded_ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """num / den where den > 0, else a constant (safe under ANSI mode)."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise))
