"""Column expressions: missing values, scaling, labels and closed-form curves. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(*cs: Column | str) -> Column:
    """True where every column is neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in map(col, cs):
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    return out


def check_columns(df: DataFrame, needed: list[str], caller: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"[{caller}] missing columns: {', '.join(missing)}\nHint: the table has {', '.join(df.columns)}")


def min_max(c: Column | str, by: list[str], constant: str = "one", lower: float = 0.0, upper: float = 1.0) -> Column:
    """Scaled to lower..upper within each group; a constant group becomes 1 ('one'), 0 ('zero') or the middle."""
    c, w = col(c), Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    flat = {"one": F.lit(1.0), "zero": F.lit(0.0), "middle": F.lit((lower + upper) / 2)}[constant]
    return F.when(hi > lo, lower + (upper - lower) * (c - lo) / (hi - lo)).otherwise(flat)


def min_max_table(df: DataFrame, names: list[str], constant: str = "one", lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Columns scaled to lower..upper over the whole table, by one row of statistics; constant columns as in min_max."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]).first()
    flat = {"one": 1.0, "zero": 0.0, "middle": (lower + upper) / 2}[constant]
    out = df
    for c in names:
        lo, hi = stats[f"lo_{c}"], stats[f"hi_{c}"]
        scaled = lower + (upper - lower) * (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(flat)
        out = out.withColumn(c, scaled)
    return out


def z_score(df: DataFrame, names: list[str], floor: float = 0.0, fill: float | None = None) -> DataFrame:
    """Columns centred and scaled by one row of statistics; a deviation at or under `floor` counts as 1."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names]).first()
    out = df
    for c in names:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        z = (F.col(c) - F.lit(m)) / F.lit(s if s is not None and s > floor else 1.0)
        out = out.withColumn(c, F.coalesce(z, F.lit(fill)) if fill is not None else z)
    return out


def node_label(c: Column | str) -> Column:
    """Lower case, blanks and hyphens to one underscore, other signs dropped, no underscore at either end."""
    x = F.regexp_replace(F.lower(F.trim(col(c))), "[-\\s]+", "_")
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9_]", ""), "_+", "_")
    return F.regexp_replace(x, "^_+|_+$", "")


def curie(c: Column | str) -> Column:
    """A local name for RDF: letters, digits and underscores, n_ before what doesn't begin with a letter."""
    x = F.regexp_replace(col(c), "[^A-Za-z0-9_]", "_")
    return F.when(x.rlike("^[A-Za-z]"), x).otherwise(F.concat(F.lit("n_"), x))


def turtle_text(c: Column | str) -> Column:
    """A quoted RDF literal; null is the empty one, line breaks need the long quotes."""
    x = F.coalesce(col(c), F.lit(""))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\\\\", "\\\\\\\\"), '"', '\\\\"'), "\t", "\\\\t")
    return F.when(x.rlike("[\n\r]"), F.concat(F.lit('"""'), x, F.lit('"""'))).otherwise(F.concat(F.lit('"'), x, F.lit('"')))


def robustness(t: Column | str, df: Column | str, q: float = 1.0) -> Column:
    """Share of residual variance that a confounder must explain of both sides to take away q of the effect."""
    f2 = (F.abs(col(t)) * q) ** 2 / col(df)
    return F.when(col(df) > 1, 0.5 * (F.sqrt(f2 * f2 + 4 * f2) - f2))


def confounder_bias(se: Column | float, df: Column | float, r2_outcome: Column, r2_exposure: Column) -> Column:
    return F.lit(se) * F.sqrt(r2_outcome * r2_exposure / (1 - r2_exposure)) * F.sqrt(F.lit(df))


def taper(distance: Column | str, radius: float) -> Column:
    """Compactly supported fifth-order correlation: 1 at distance 0, 0 from two radii on."""
    z = col(distance) / radius
    # fixed values: the published function's coefficients
    near = 1 - 5 / 3 * z**2 + 5 / 8 * z**3 + 1 / 2 * z**4 - 1 / 4 * z**5
    far = 4 - 5 * z + 5 / 3 * z**2 + 5 / 8 * z**3 - 1 / 2 * z**4 + 1 / 12 * z**5 - 2 / (3 * z)
    return F.greatest(F.lit(0.0), F.when(z <= 1, near).when(z <= 2, far).otherwise(F.lit(0.0)))


def depth_curve(depth: Column | str, y0: Column, y_inf: Column, rate: Column, decay: Column) -> Column:
    """Solution of dy/dz = -rate * exp(-decay z) (y - y_inf) from y0 at the surface."""
    z = col(depth)
    path = F.when(F.abs(decay) < 1e-12, rate * z).otherwise(rate * (1 - F.exp(-decay * z)) / decay)
    return y_inf + (y0 - y_inf) * F.exp(-path)


def noise_schedule(t: Column | str, steps: int, s: float = 0.008) -> Column:
    """Cumulative signal share of the cosine schedule at step t. The published offset 0.008 and bounds."""
    f = lambda x: F.cos((x / steps + s) / (1 + s) * math.pi / 2) ** 2
    return F.greatest(F.lit(1e-8), F.least(F.lit(0.9999), f(col(t)) / f(F.lit(0.0))))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def record_hash(record_id: Column | str, text: Column | str) -> Column:
    """Identity of an extraction: the id and how the text begins."""
    return F.md5(F.concat_ws(" ", col(record_id).cast("string"), F.substring(col(text), 1, 200)))


def in_polygon(x: Column | str, y: Column | str, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: an odd number of sides crossed on the way to the right. The bounding box is a
    plain predicate before it, which a scan can push down."""
    px, py = col(x), col(y)
    xs, ys = [a for a, _ in corners], [b for _, b in corners]
    box = px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 != y2:
            side = ((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
            crossed = crossed + side.cast("int")
    return box & (crossed % 2 == 1)


def in_range(c: Column | str, low: float, high: float) -> Column:
    """Text or number as a double inside the range; what is no number isn't."""
    return F.coalesce(col(c).cast("string").try_cast("double").between(low, high), F.lit(False))
