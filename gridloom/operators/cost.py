"""Masks, feature stack, labels and the fused cost surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.config import BAND_LAYERS, BANDS, LABEL_COST, SOFT_FACTOR, EngineConfig
from gridloom.grid import Grid
from gridloom.operators.focal import masked_gaussian
from gridloom.operators.risk import clip


def layer(df: DataFrame, name: str, default: float | None) -> Column:
    """A layer, or the default where the frame has none."""
    return F.col(name) if name in df.columns else F.lit(default).cast("double")


def hard_mask(df: DataFrame, config: EngineConfig) -> DataFrame:
    """Adds hard_mask: 0 where any rule that a layer is there for forbids the cell. protected: 1 within the buffered areas."""
    rules = [
        ("slope", F.col("slope") > config.max_slope if "slope" in df.columns else None),
        ("dist_water", F.col("dist_water") < config.water_buffer_m if "dist_water" in df.columns and config.water_buffer_m > 0 else None),
        ("protected", F.col("protected") == 1 if "protected" in df.columns else None),
        ("z", F.col("z") > config.max_elevation if "z" in df.columns else None),
        ("density", F.col("density") > config.max_density if "density" in df.columns else None),
    ]
    bad = F.lit(False)
    for _, rule in rules:
        if rule is not None:
            bad = bad | F.coalesce(rule, F.lit(False))
    return df.withColumn("hard_mask", F.when(bad, 0).otherwise(1))


def _lookup(code: Column, values: dict[int, float], default: float) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code.cast("int")], F.lit(default))


def soft_mask(df: DataFrame, config: EngineConfig) -> DataFrame:
    """Adds soft_mask: the land-use code's factor, or by slope if there is no land use."""
    mask = _lookup(F.col("landuse"), SOFT_FACTOR, 0.2) if "landuse" in df.columns else 1 - 0.7 * clip(F.col("slope") / config.max_slope, 0, 1)
    return df.withColumn("soft_mask", mask)


def feature_stack(df: DataFrame) -> DataFrame:
    """row, col and the 18 bands in order; what is absent, null or not finite is 0."""
    value = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double")).otherwise(0.0)
    bands = []
    for band in BANDS:
        name = BAND_LAYERS.get(band, band)
        bands.append((value(name) if name in df.columns else F.lit(0.0)).alias(band))
    return df.select("row", "col", *bands)


def pseudo_label(df: DataFrame, config: EngineConfig, noise: float = 0.03) -> DataFrame:
    """Adds label in 0 to 1, null where hard_mask is 0. noise: half the width of a uniform term drawn from a hash of the cell."""
    line, slope_w, land_w, road, rail, water, slide = config.weights
    fall = lambda name, decay: F.exp(-F.col(name) / decay)
    steep = F.col("slope") / config.slope_reference
    steep = F.when(F.col("slope") > config.steep, steep * 1.5).otherwise(steep)
    land = _lookup(F.col("landuse"), LABEL_COST, 0.3) if "landuse" in df.columns else F.lit(0.3)
    built = clip(F.col("density") / 5000, 0, 1) if "density" in df.columns else F.lit(0.1)
    rough = clip(F.col("roughness") / 30, 0, 1) if "roughness" in df.columns else F.lit(0.3)
    total = (
        (line * (1 - fall("dist_line", config.line_decay)) if "dist_line" in df.columns else F.lit(line * 0.4))
        + (slope_w * steep if "slope" in df.columns else F.lit(slope_w * 0.3))
        + land_w * (0.5 * land + 0.3 * built + 0.2 * rough)
        + (road * (1 - fall("dist_road", config.road_decay)) if "dist_road" in df.columns else F.lit(road * 0.3))
        + (rail * (1 - fall("dist_rail", config.rail_decay)) if "dist_rail" in df.columns else F.lit(rail * 0.3))
        + (water * fall("dist_water", config.water_decay) if "dist_water" in df.columns else F.lit(0.0))
        + slide * layer(df, "landslide", 0.2)
    )
    if noise:
        uniform = F.pmod(F.xxhash64("row", "col", F.lit(config.seed)), F.lit(1 << 20)) / float(1 << 20)
        total = total + (uniform * 2 - 1) * noise
    out = clip(total, 0, 1)
    return df.withColumn("label", F.when(F.col("hard_mask") == 1, out) if "hard_mask" in df.columns else out)


def fuse(grid: Grid, config: EngineConfig, sigma: float = 1.0) -> DataFrame:
    """Adds cost of cells with predicted, dist_line, soft_mask, hard_mask: null where impassable."""
    bonus = config.corridor_min + (1 - config.corridor_min) * clip(F.col("dist_line") / config.corridor_range, 0, 1)
    df = grid.df.withColumn("_raw", F.col("predicted") * bonus * clip(F.col("soft_mask"), 0.01, 1))
    return masked_gaussian(grid.with_df(df), "_raw", "hard_mask", sigma, "cost").drop("_raw")
