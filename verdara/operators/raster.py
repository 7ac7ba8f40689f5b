"""Pixel-table operators.

A raster stack is a table (raster, row, col, band, value) plus one metadata row
per raster (raster, x0, y0, dx, dy, nodata, crs).  Band dictionaries name the
bands; they are driver-side mappings with one entry per band of a sensor, so the
features of a pixel become one conditional aggregation with no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.functions.radar import (
    finite_or_null, intensity_parts, is_finite, parse_decomposition, parse_intensity)
from verdara.operators.spread import join_lookup
from verdara.sources.scratch import stored

PIXEL = ("raster", "row", "col")
# Feature tokens that a map can be built from.
INTENSITY_TOKENS = ("sigma0_vv", "sigma0_vh", "gamma0_vv", "gamma0_vh")
CROSS_TOKENS = ("sigma0_sum_vhvv", "sigma0_ratio_vh_vv", "gamma0_sum_vhvv", "gamma0_ratio_vh_vv")
DECOMPOSITION_TOKENS = ("entropy", "anisotropy", "alpha")
INDEX_TOKENS = ("dprvi",)


def scan_parcels(pixels: DataFrame, rasters: Sequence[str]) -> DataFrame:
    """Pixels of the listed rasters; prunes partitions when stored by raster."""
    return pixels.where(F.col("raster").isin(list(rasters)))


def name_bands(pixels: DataFrame, bands: Mapping[int, str]) -> DataFrame:
    """Add ``band_name``; an unnamed band is called ``Banda NN``."""
    return pixels.withColumn("band_name", F.coalesce(
        _lookup(bands), F.format_string("Banda %02d", F.col("band"))))


def _lookup(bands: Mapping[int, str]) -> Column:
    if not bands:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for b, n in sorted(bands.items()) for x in (b, n)])
    return F.try_element_at(table, F.col("band"))


def mapped_intensity_bands(pixels: DataFrame, bands: Mapping[int, str]) -> DataFrame:
    """Pixels of bands with a readable intensity name, with prod, pol and date."""
    parsed = {b: p for b, n in bands.items() if (p := parse_intensity(n))}
    named = pixels.where(F.col("band").isin(list(parsed))).withColumn("_n", _lookup(bands))
    parts = intensity_parts(F.col("_n"))
    return named.select(
        *pixels.columns, F.initcap(parts["prod"]).alias("prod"), parts["pol"].alias("pol"),
        parts["date"].alias("date_tag"))


def raster_catalogue(pixels: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(raster, n_rows, n_cols, n_bands) with the metadata columns if given.

    Bands are de-duplicated per raster before they are counted, so the count needs
    one row per (raster, band) only.
    """
    size = (pixels.groupBy("raster", "band")
            .agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
            .groupBy("raster")
            .agg((F.max("_r") + 1).cast("int").alias("n_rows"),
                 (F.max("_c") + 1).cast("int").alias("n_cols"),
                 F.count(F.lit(1)).alias("n_bands")))
    return size if meta is None else size.join(meta, "raster", "left")


def _valid(nodata: float | None, rule: str, inside: Column) -> Column:
    """Aggregate validity of one stack: ``inside`` marks the rows of the stack."""
    if rule not in ("all", "any"):
        raise ValueError("nodata rule must be 'all' or 'any'")
    value = F.col("value")
    finite = F.bool_and(F.when(inside, is_finite(value)))
    if nodata is None:
        return F.coalesce(finite, F.lit(True))
    hit = F.when(inside, value == F.lit(nodata).cast("float"))
    empty = F.bool_and(hit) if rule == "all" else F.bool_or(hit)
    return F.coalesce(finite & ~empty, F.lit(True))


def valid_pixels(pixels: DataFrame, nodata: float | None = None, rule: str = "all") -> DataFrame:
    """Pixels kept: not nodata in all bands, and every band finite."""
    return (pixels.groupBy(*PIXEL).agg(_valid(nodata, rule, F.lit(True)).alias("_ok"))
            .where("_ok").select(*PIXEL))


def temporal_mean(pixels: DataFrame, bands: Sequence[int], name: str = "mean") -> DataFrame:
    """Per-pixel mean of the listed bands, skipping values that are not finite."""
    return (pixels.where(F.col("band").isin(list(bands))).groupBy(*PIXEL)
            .agg(F.avg(finite_or_null(F.col("value"))).alias(name)))


class _Features:
    """Turns feature tokens into aggregates over the rows of one pixel."""

    def __init__(self, stacks: Mapping[str, Mapping[int, str]]):
        self.stacks = stacks
        self.aggs: dict[str, Column] = {}

    def _inside(self, stack: str, bands: Sequence[int]) -> Column:
        return (F.col("stack") == stack) & F.col("band").isin(list(bands))

    def _band(self, band: int) -> Column:
        """One band's value; finite or NULL."""
        name = f"_b{band}"
        self.aggs.setdefault(name, F.max(F.when(
            self._inside("intensity", [band]), F.col("_v"))).alias(name))
        return F.col(name)

    def _mean_of(self, token: str, stack: str, bands: Sequence[int]) -> Column:
        if not bands:
            raise ValueError(f"feature {token!r} cannot be built from the given stacks")
        name = f"_m_{token}"
        self.aggs.setdefault(name, F.avg(F.when(
            self._inside(stack, bands), F.col("_v"))).alias(name))
        return F.col(name)

    def _intensity(self) -> dict[tuple[str, str], dict[str, int]]:
        found: dict[tuple[str, str], dict[str, int]] = {}
        for band, name in sorted(self.stacks.get("intensity", {}).items()):
            parts = parse_intensity(name)
            if parts:
                found.setdefault((parts[0].lower(), parts[1]), {})[parts[2]] = band
        return found

    def _all_intensity(self, prod: str, pol: str) -> list[int]:
        return [b for b, n in sorted(self.stacks.get("intensity", {}).items())
                if (p := parse_intensity(n)) and (p[0].lower(), p[1]) == (prod, pol)]

    def column(self, token: str) -> Column:
        key = token.strip().lower()
        if key in INDEX_TOKENS:
            return self._mean_of(key, "dprvi", sorted(self.stacks.get("dprvi", {})))
        if key in DECOMPOSITION_TOKENS:
            bands = [b for b, n in sorted(self.stacks.get("haalpha", {}).items())
                     if (p := parse_decomposition(n)) and p[0].lower() == key]
            return self._mean_of(key, "haalpha", bands)
        if key in INTENSITY_TOKENS:
            prod, pol = key.split("_")
            return self._mean_of(key, "intensity", self._all_intensity(prod, pol.upper()))
        if key in CROSS_TOKENS:
            prod, metric = key.split("_", 1)
            return self._cross(key, prod, metric)
        raise ValueError(f"unknown feature token: {token!r}")

    def _cross(self, key: str, prod: str, metric: str) -> Column:
        """Mean over the common dates of VH+VV or VH/VV (the mean of the ratios)."""
        found = self._intensity()
        vh, vv = found.get((prod, "VH"), {}), found.get((prod, "VV"), {})
        days = sorted(vh.keys() & vv.keys())
        if not days:
            raise ValueError(f"feature {key!r} cannot be built from the given stacks")
        terms = []
        for day in days:
            a, b = self._band(vh[day]), self._band(vv[day])
            if metric == "sum_vhvv":
                terms.append(a + b)
            else:
                # x/0 is infinite and spoils the pixel; 0/0 is missing and skipped
                terms.append(F.when(b != 0, a / F.nullif(b, F.lit(0.0)))
                             .when((b == 0) & (a != 0), F.lit(float("inf"))))
        n = reduce(lambda x, y: x + y, [t.isNotNull().cast("int") for t in terms])
        total = reduce(lambda x, y: x + y, [F.coalesce(t, F.lit(0.0)) for t in terms])
        return F.try_divide(total, n)


def stack_pixels(stacks: Mapping[str, DataFrame | None]) -> DataFrame:
    """One pixel table from the stacks at hand; missing stacks are left out."""
    present = {k: v for k, v in stacks.items() if v is not None}
    if not present:
        raise ValueError("no raster stack found")
    parts = [df.select(*PIXEL, "band", "value").withColumn("stack", F.lit(name))
             for name, df in present.items()]
    return reduce(DataFrame.unionByName, parts)


def pixel_features(pixels: DataFrame, bands: Mapping[str, Mapping[int, str]],
                   features: Sequence[str], nodata: Mapping[str, float | None] | None = None,
                   rule: str = "all", keep_invalid: bool = False) -> DataFrame:
    """(raster, row, col, one column per feature) of every valid pixel.

    ``pixels`` carries a ``stack`` column (intensity, dprvi, haalpha).  Masks and
    all features come out of one grouped aggregation, so a pixel's rows are moved
    once.  With ``keep_invalid`` the invalid pixels stay, with ``valid`` false and
    NULL features, which makes the later raster frame complete without a join.
    """
    build = _Features(bands)
    columns = {f: build.column(f) for f in features}
    nodata = nodata or {}
    masks = {s: _valid(nodata.get(s), rule, F.col("stack") == s).alias(f"_ok_{s}")
             for s in bands}
    rows = pixels.withColumn("_v", finite_or_null(F.col("value")))
    wide = rows.groupBy(*PIXEL).agg(*masks.values(), *build.aggs.values())
    made = wide.select(*PIXEL, *[F.col(f"_ok_{s}") for s in masks],
                       *[c.alias(f) for f, c in columns.items()])
    ok = reduce(lambda a, b: a & b,
                [F.col(f"_ok_{s}") for s in masks] + [is_finite(F.col(f"`{f}`")) for f in columns])
    if keep_invalid:
        return made.withColumn("valid", ok).select(
            *PIXEL, "valid", *[F.when(F.col("valid"), F.col(f"`{f}`")).alias(f) for f in columns])
    return made.where(ok).select(*PIXEL, *[F.col(f"`{f}`") for f in columns])


def ratio_of_means(pixels: DataFrame, bands: Mapping[int, str],
                   products: Sequence[str] = ("Sigma0", "Gamma0"),
                   nodata: float | None = None, keep_invalid: bool = False) -> DataFrame:
    """``<prod>_RATIO_VH_VV`` as mean(VH)/mean(VV); differs from the mean of ratios."""
    one = pixels if "stack" in pixels.columns else pixels.withColumn("stack", F.lit("intensity"))
    parts = [f"{p}_{pol}" for p in products for pol in ("VH", "VV")]
    means = pixel_features(one, {"intensity": bands}, parts, {"intensity": nodata},
                           keep_invalid=True)
    names = [f"{p}_RATIO_VH_VV" for p in products]
    ratios = [F.try_divide(F.col(f"{p}_VH"), F.col(f"{p}_VV")).alias(n)
              for p, n in zip(products, names)]
    out = means.select(*PIXEL, *ratios)
    ok = reduce(lambda a, b: a & b, [is_finite(F.col(n)) for n in names])
    return out.withColumn("valid", ok).select(*PIXEL, "valid", *names) if keep_invalid \
        else out.where(ok)


def has_valid_pixel(features: DataFrame) -> None:
    """Raise when masking left nothing; looks for one row only."""
    if features.isEmpty():
        raise ValueError("no valid pixel after masking")


def locate_points(points: DataFrame, meta: DataFrame, raster_col: str,
                  x_col: str = "long", y_col: str = "lat") -> DataFrame:
    """Points with the row and col of their pixel; NULL where the raster is unknown."""
    grid = meta.select(F.col("raster").alias(raster_col), "x0", "y0", "dx", "dy")
    on_grid = points.join(grid, raster_col, "left")
    return (on_grid
            .withColumn("row", F.floor((F.col("y0") - F.col(y_col)) / F.col("dy")).cast("int"))
            .withColumn("col", F.floor((F.col(x_col) - F.col("x0")) / F.col("dx")).cast("int"))
            .drop("x0", "y0", "dx", "dy"))


def sample_points(points: DataFrame, pixels: DataFrame, meta: DataFrame,
                  bands: Mapping[int, str], id_cols: Sequence[str],
                  raster_col: str = "id_parcel", x_col: str = "long",
                  y_col: str = "lat") -> DataFrame:
    """(ids, one column per band name): value of the pixel under each point.

    Only the pixels under some point are read further: their list is written once, so Spark
    broadcasts it to the scan if it is small.  They are brought to one row per pixel, so the
    join meets a unique side and a pixel with very many points is split.  A point outside its raster keeps its row with NULL values.
    """
    cells = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(n)
             for b, n in sorted(bands.items())]
    spots = locate_points(points, meta, raster_col, x_col, y_col)
    wanted = stored(spots.select(F.col(raster_col).alias("raster"), "row", "col").distinct())
    wide = (scan_bands(pixels, list(bands)).join(wanted, list(PIXEL), "left_semi")
            .groupBy(*PIXEL).agg(*cells).withColumnRenamed("raster", raster_col))
    return (join_lookup(spots, wide, [raster_col, "row", "col"])
            .select(*id_cols, *[F.col(f"`{n}`") for _, n in sorted(bands.items())]))


def scan_bands(pixels: DataFrame, bands: Sequence[int]) -> DataFrame:
    return pixels.where(F.col("band").isin(list(bands)))


def prediction_raster(scored: DataFrame, pred_col: str = "prediction",
                      nodata: float = -9999.0) -> DataFrame:
    """(raster, row, col, pred) as float with ``nodata`` where nothing is predicted."""
    value = F.when(F.col("valid") & is_finite(F.col(pred_col)), F.col(pred_col))
    return scored.select(*PIXEL, F.coalesce(value, F.lit(nodata)).cast("float").alias("pred"))


def full_frame(scored: DataFrame, catalogue: DataFrame, pred_col: str = "pred",
               nodata: float = -9999.0) -> DataFrame:
    """Write predictions back onto the whole (row, col) frame of each raster.

    Frame rows are generated by row first and by column second, so a large raster
    is spread over many tasks; predictions are unique by pixel.
    """
    rows = catalogue.select(
        "raster", "n_cols",
        F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    frame = (rows.repartition("raster", "row")
             .select("raster", "row",
                     F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col")))
    return (frame.join(scored.select(*PIXEL, F.col(pred_col).alias("_p")), list(PIXEL), "left")
            .select(*PIXEL, F.coalesce("_p", F.lit(nodata)).cast("float").alias("pred")))
