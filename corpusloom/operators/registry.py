"""Value registries: how often values occur and where, leader clusters, rhythms and other shares of a registry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as co
from ..functions.text import round_half_up
from .sequence import firsts

LOCATIONS = 20


def inventory(found: DataFrame, least: int = 3, most: int = LOCATIONS) -> DataFrame:
    """value, n, locations (the first `most` by path and line) of values that occur `least` times or more, most frequent first.

    found: value, path, line. Counts combine before the shuffle, and so does the limit on locations: a value that occurs
    everywhere sends few rows.
    """
    counts = found.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    places = firsts(found.select("value", "path", "line").distinct(), ["value"], ["path", "line"], most)
    locations = places.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("locations"))
    return counts.join(locations, "value").orderBy(F.col("n").desc(), "value")


def first_location(found: DataFrame, least: int = 3) -> DataFrame:
    """value, n, first_path, first_line: an inventory with the first location only; aggregates combine before the shuffle."""
    out = found.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("first")).where(F.col("n") >= least)
    return out.select("value", "n", F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"))


def leader_clusters(registry: DataFrame, tolerance: float, by: list[str] | None = None) -> DataFrame:
    """leader, members, usage of clusters of close numbers (value double, usages long), in each group of `by`.

    In ascending order a value joins the current cluster if it is within tolerance of the cluster's first value, else leads
    a new one. The distance is to the leader, so this is a fold, over a group's distinct values only (few, whatever
    the number of usages).
    """
    by = by or []
    cells = F.array_sort(F.collect_list(F.struct("value", "usages")))
    kind = "array<struct<leader:double,members:bigint,usage:bigint>>"

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        fresh = F.struct(x["value"].alias("leader"), F.lit(1).cast("bigint").alias("members"), x["usages"].alias("usage"))
        grown = F.struct(last["leader"].alias("leader"), (last["members"] + 1).alias("members"), (last["usage"] + x["usages"]).alias("usage"))
        joins = (F.size(out) > 0) & (F.abs(x["value"] - F.try_element_at(out, F.lit(-1))["leader"]) <= tolerance)
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(fresh)))

    base = registry.select(*by, F.col("value").cast("double").alias("value"), F.col("usages").cast("bigint").alias("usages")).groupBy(*by, "value").agg(F.sum("usages").alias("usages"))
    folded = base.groupBy(*by).agg(F.aggregate(cells, F.array().cast(kind), step).alias("c"))
    return folded.select(*by, F.explode("c").alias("c")).select(*by, "c.leader", "c.members", "c.usage")


def delta_e(lab: np.ndarray, others: np.ndarray) -> np.ndarray:
    """CIEDE2000 of Lab triples and others, on the last axis of either; the axes before it broadcast."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(lab, -1, 0), np.moveaxis(others, -1, 0)
    c7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 1 + 0.5 * (1 - np.sqrt(c7 / (c7 + 25.0**7)))
    c1, c2 = np.hypot(g * a1, b1), np.hypot(g * a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, g * a1)) % 360, np.degrees(np.arctan2(b2, g * a2)) % 360
    grey, gap, total = c1 * c2 == 0, h2 - h1, h1 + h2
    turn = np.where(grey, 0.0, (gap + 180) % 360 - 180)
    turn = np.where(gap == 180, 180.0, turn)
    mid = np.where(grey, total, np.where(np.abs(gap) <= 180, total / 2, np.where(total < 360, total / 2 + 180, total / 2 - 180)))
    cos = lambda x: np.cos(np.radians(x))
    t = 1 - 0.17 * cos(mid - 30) + 0.24 * cos(2 * mid) + 0.32 * cos(3 * mid + 6) - 0.20 * cos(4 * mid - 63)
    l50, c = ((l1 + l2) / 2 - 50) ** 2, (c1 + c2) / 2
    dl = (l2 - l1) / (1 + 0.015 * l50 / np.sqrt(20 + l50))
    dc = (c2 - c1) / (1 + 0.045 * c)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * c * t)
    rt = -2 * np.sqrt(c**7 / (c**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((mid - 275) / 25) ** 2))))
    return np.sqrt(dl**2 + dc**2 + dh**2 + rt * dc * dh)


def _reach(chroma: np.ndarray, least: float, most: float, warm: np.ndarray, threshold: float) -> np.ndarray:
    """A bound on the distance in the (a, b) plane of colors of a chroma to any of a chroma from `least` to `most` within a CIEDE2000 threshold.

    The mean chroma m' is at most (1 + G) times the mean of both, and G falls with it. The rotation term is at most sqrt(3) sqrt(m'^7 / (m'^7 + 25^7)), and
    next to nothing where both hues are in 0..180 (`warm`), far from 275. So (dC / S_C)^2 + (dH / S_H)^2 <= threshold^2 / (1 - R / 2), and S_H <= S_C =
    1 + 0.045 m'; a distance in (a, b) is no larger than in (a', b).
    """
    part = lambda c: np.sqrt(c**7 / (c**7 + 25.0**7))
    m = (1 + 0.5 * (1 - part((chroma + least) / 2))) * (chroma + most) / 2
    turn = np.where(warm, 1e-5, np.sqrt(3) * part(m))
    return threshold / np.sqrt(1 - turn / 2) * (1 + 0.045 * m) + 1e-6


class _Leaders:
    """Leaders in order; a color's first leader within the threshold, found among those that its cell of the Lab space can reach."""

    CELL = np.array([4.0, 8.0, 8.0])

    def __init__(self, threshold: float):
        self.threshold, self.n, self.held, self.rows = threshold, 0, 0, np.zeros((1024, 3))

    def add(self, lab: np.ndarray) -> int:
        if self.n == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = lab
        self.n += 1
        return self.n - 1

    def first(self, labs: np.ndarray) -> np.ndarray:
        """The place of each color's first leader, -1 if there is none yet."""
        out = np.full(len(labs), -1)
        known = self.rows[: self.n]
        if not self.n:
            return out
        cells, own = np.unique(np.floor(labs / self.CELL), axis=0, return_inverse=True)
        order = np.argsort(own.ravel(), kind="stable")
        bounds = np.searchsorted(own.ravel()[order], np.arange(len(cells) + 1))
        chroma, half = np.hypot(known[:, 1], known[:, 2]), np.hypot(*self.CELL[1:]) / 2
        high = 1.75 * self.threshold + self.CELL[0] / 2  # S_L <= 1 + 0.015 * 2500 / sqrt(2520) < 1.75 for L in 0..100
        for k, cell in enumerate((cells + 0.5) * self.CELL):
            own_chroma = np.hypot(cell[1], cell[2])
            warm = (known[:, 2] >= 0) & (cell[2] >= self.CELL[2] / 2)
            reach = _reach(chroma, max(0.0, own_chroma - half), own_chroma + half, warm, self.threshold) + half
            near = np.flatnonzero((np.abs(known[:, 0] - cell[0]) <= high) & (np.hypot(known[:, 1] - cell[1], known[:, 2] - cell[2]) <= reach))
            for at in np.array_split(order[bounds[k] : bounds[k + 1]], 1 + (bounds[k + 1] - bounds[k]) * len(near) // 1_000_000):
                if len(near) and len(at):
                    self.held += len(at) * len(near)
                    hits = delta_e(labs[at][:, None], known[near]) <= self.threshold
                    out[at] = np.where(hits.any(axis=1), near[hits.argmax(axis=1)], -1)
        return out


#: Colors that are held against the leaders at once.
_BLOCK = 16_384


def color_clusters(registry: DataFrame, threshold: float = 3.5) -> DataFrame:
    """id, leader, members (array), usage of clusters of colors (hex #rrggbb, usages) that look alike.

    In order of usage (then hex) a color joins the first leader within the CIEDE2000 threshold, else leads. Each choice depends on
    all before it, so one Arrow task goes through the distinct colors (16,777,216 at most; usages are summed before it). It reads
    them as a sorted stream and holds the leaders and one block of colors; each color is held only against leaders near it. Ids
    number the clusters as they begin, rows come by usage.
    """
    own = registry.groupBy("hex").agg(F.sum("usages").alias("usages")).withColumn("lab", co.lab(F.substring("hex", 2, 6)))
    cells = own.select("hex", "usages", "lab.L", "lab.a", "lab.b").repartition(1).sortWithinPartitions(F.col("usages").desc(), "hex")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, names = _Leaders(threshold), []

        def told(hexes: list[str], usages: pa.Array, labs: np.ndarray) -> pa.RecordBatch:
            place = leaders.first(labs)
            left = np.flatnonzero(place < 0)
            while len(left):
                k, left = left[0], left[1:]
                place[k] = leaders.add(labs[k])
                names.append(hexes[k])
                joins = delta_e(labs[left], labs[k]) <= threshold
                place[left[joins]] = place[k]
                left = left[~joins]
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([names[p] for p in place], pa.string()), pa.array(hexes, pa.string()), usages], ["place", "leader", "hex", "usages"])

        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                labs = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("L", "a", "b")], axis=1)
                yield told(part.column("hex").to_pylist(), part.column("usages").cast(pa.int64()), labs)

    joined = cells.mapInArrow(fold, "place long, leader string, hex string, usages long")
    members = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("usages")).alias("order"), "hex"))), lambda x: x["hex"])
    found = joined.groupBy("place", "leader").agg(members.alias("members"), F.sum("usages").alias("usage"))
    out = found.select(F.concat(F.lit("color-cluster-"), F.col("place") + 1).alias("id"), "leader", "members", "usage")
    return out.orderBy(F.col("usage").desc(), "leader")


class _Lab:
    """A struct column whose fields read as attributes."""

    def __init__(self, c: Column):
        self.L, self.a, self.b = c["L"], c["a"], c["b"]


def lab_fields(c: Column) -> _Lab:
    return _Lab(c)


def rhythm(registry: DataFrame) -> DataFrame:
    """base, fit: the one of 4, 5, 8, 10 that divides most usages (the earlier at a tie), and its share. Null and 0 without usages."""
    total = F.sum("usages")
    fit = lambda b: round_half_up(F.sum(F.when(F.col("value") % b == 0, F.col("usages")).otherwise(0)) / total)
    fits = registry.agg(total.alias("total"), *(fit(b).alias(f"f{b}") for b in (4, 5, 8, 10)))
    best = F.array_max(F.array(*(F.struct(F.col(f"f{b}").alias("fit"), F.lit(-k).alias("k"), F.lit(b).alias("base")) for k, b in enumerate((4, 5, 8, 10)))))
    return fits.select(F.when(F.col("total") > 0, best["base"]).alias("base"), F.when(F.col("total") > 0, best["fit"]).otherwise(0.0).alias("fit"))


def radius_language(registry: DataFrame) -> DataFrame:
    """sharp, soft, large, pill (shares of usages) and dominant (the earlier at a tie)."""
    v, total = F.col("value"), F.sum("usages")
    kind = F.when(v >= 999, "pill").when(v <= 4, "sharp").when(v <= 12, "soft").otherwise("large")
    names = ("sharp", "soft", "large", "pill")
    shares = registry.agg(total.alias("total"), *(round_half_up(F.sum(F.when(kind == n, F.col("usages")).otherwise(0)) / total).alias(n) for n in names))
    best = F.array_max(F.array(*(F.struct(F.col(n).alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(names))))
    return shares.select(*names, F.when(F.col("total") > 0, best["n"]).alias("dominant"))


def density(registry: DataFrame) -> DataFrame:
    """generous (share of usages of 24 and more), efficient (share over 0 up to 12), axis."""
    v, u, total = F.col("value"), F.col("usages"), F.sum("usages")
    out = registry.agg(total.alias("total"), (F.sum(F.when(v >= 24, u).otherwise(0)) / total).alias("generous"), (F.sum(F.when((v > 0) & (v <= 12), u).otherwise(0)) / total).alias("efficient"))
    axis = F.when(F.coalesce("total", F.lit(0)) == 0, "unknown").when(F.col("generous") > 0.4, "generous").when(F.col("efficient") > 0.6, "efficient").otherwise("balanced")
    return out.select("generous", "efficient", axis.alias("axis"))


def palette(registry: DataFrame) -> DataFrame:
    """avg_hue (circular mean of saturated colors), avg_saturation, avg_lightness, dominant hue family (neutral if none): usage-weighted, of hex, usages.

    One pass sums by family. No filter stands over the registry: it would be tested below the count of usages, on each use of a color.
    """
    h = co.hsl(F.substring("hex", 2, 6))
    rows = registry.select("usages", h.alias("c"))
    vivid, w = F.col("c.s") > 0.1, F.col("usages")
    x = F.sum(F.when(vivid, F.cos(F.radians("c.h")) * w).otherwise(0.0))
    y = F.sum(F.when(vivid, F.sin(F.radians("c.h")) * w).otherwise(0.0))
    sums = {"x": x, "y": y, "s": F.sum(F.col("c.s") * w), "l": F.sum(F.col("c.l") * w), "n": F.sum(w)}
    families = rows.groupBy(F.when(vivid, co.hue_family(F.col("c.h"))).alias("f")).agg(*(v.alias(k) for k, v in sums.items()))
    hue = F.pmod(F.degrees(F.atan2(F.sum("y"), F.sum("x"))) + 360, F.lit(360.0))
    mean = lambda c: round_half_up(F.sum(c) / F.sum("n"))
    top = F.max(F.when(F.col("f").isNotNull(), F.struct("n", "f")))["f"]
    return families.agg(F.floor(hue + 0.5).cast("int").alias("avg_hue"), mean("s").alias("avg_saturation"), mean("l").alias("avg_lightness"), F.coalesce(top, F.lit("neutral")).alias("dominant_hue"))


#: Font families that are the platform's own.
SYSTEM_FONTS = r"(?i)^system$|^-apple-system$|^Roboto$|^Helvetica"


def incoherence(facts: DataFrame, threshold: float = 3.5) -> DataFrame:
    """rule, severity, detail: contradictions of a style inventory (facts: kind, value, path)."""
    usages = facts.groupBy("kind", "value").agg(F.count("*").alias("usages"))
    numbers = usages.where("kind in ('fontSize', 'spacing', 'radius')").withColumn("value", F.col("value").cast("double"))
    colors = color_clusters(usages.where("kind = 'color'").select(F.col("value").alias("hex"), "usages"), threshold)
    found = lambda df, rule, severity, detail: df.select(F.lit(rule).alias("rule"), severity.alias("severity"), detail.cast("string").alias("detail"))
    grade = lambda severe: F.when(severe, "severe").otherwise("moderate")
    doubles = found(colors.where(F.size("members") >= 2), "perceptual-color-duplicate", grade(F.size("members") >= 4), F.col("leader"))
    spacing = leader_clusters(numbers.where("kind = 'spacing'"), 2.0).select(F.col("leader").alias("value"), F.col("usage").alias("usages"))
    beat = rhythm(numbers.where("kind = 'spacing'")).where("base is not null")
    off = spacing.join(F.broadcast(beat), how="cross").where("value not in (0, 1) and value % base <> 0").agg(F.count("*").alias("n"), F.any_value("fit").alias("fit"))
    mixed = found(off.where("n > 0 and fit < 0.8"), "mixed-spacing-rhythm", grade(F.col("fit") < 0.6), F.col("n"))
    lang = radius_language(numbers.where("kind = 'radius'")).where("dominant is not null")
    voices = sum((F.when(F.col(n) >= 0.15, 1).otherwise(0) for n in ("sharp", "soft", "large", "pill")), F.lit(0))
    both = (F.col("sharp") >= 0.15) & (F.col("pill") >= 0.15)
    radii = lang.where((voices >= 3) | both).select(F.when(voices >= 3, "mixed-radius-language").otherwise("sharp-and-pill-coexist").alias("rule"), grade(voices >= 3).alias("severity"), voices.cast("string").alias("detail"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    fonts = count(usages.where("kind = 'fontFamily'").where(~F.col("value").rlike(SYSTEM_FONTS)))
    sizes = count(leader_clusters(numbers.where("kind = 'fontSize'"), 1.0))
    out = doubles.unionByName(mixed).unionByName(radii)
    for df, rule, some, many in ((fonts, "too-many-font-families", 3, 5), (sizes, "undisciplined-type-scale", 10, 15), (count(colors), "palette-overpopulated", 12, 20)):
        out = out.unionByName(found(df.where(F.col("n") >= some), rule, grade(F.col("n") >= many), F.col("n")))
    return out


def incoherence_verdict(findings: DataFrame) -> DataFrame:
    """severe, moderate, verdict."""
    severe, n = F.count_if(F.col("severity") == "severe"), F.count("*")
    verdict = F.when(severe >= 3, "incoherent").when((n >= 4) | (severe >= 1), "mixed").when(n > 0, "mostly-coherent").otherwise("coherent")
    return findings.agg(severe.alias("severe"), F.count_if(F.col("severity") == "moderate").alias("moderate"), verdict.alias("verdict"))


def font_families(facts: DataFrame) -> DataFrame:
    """family, usages of a style inventory (facts: kind, value, path), most used first."""
    return facts.where("kind = 'fontFamily'").groupBy(F.col("value").alias("family")).agg(F.count("*").alias("usages")).orderBy(F.col("usages").desc(), "family")


def inventory_summary(facts: DataFrame, files: DataFrame, threshold: float = 3.5) -> DataFrame:
    """One row: files; raw and perceived colors, font sizes, spacings and radii; font families; rhythm and its fit; the dominant corner language."""
    usages = facts.groupBy("kind", "value").agg(F.count("*").alias("usages"))
    number = lambda k: usages.where(F.col("kind") == k).select(F.col("value").cast("double").alias("value"), "usages")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    raw = usages.agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("color", "raw_colors"), ("fontSize", "raw_font_sizes"), ("spacing", "raw_spacings"), ("radius", "raw_radii"), ("fontFamily", "font_families"))))
    parts = [
        count(files, "files"),
        count(color_clusters(usages.where("kind = 'color'").select(F.col("value").alias("hex"), "usages"), threshold), "colors"),
        count(leader_clusters(number("fontSize"), 1.0), "font_sizes"),
        count(leader_clusters(number("spacing"), 2.0), "spacings"),
        count(leader_clusters(number("radius"), 2.0), "radii"),
        rhythm(number("spacing")).select(F.col("base").alias("rhythm"), "fit"),
        radius_language(number("radius")).select(F.col("dominant").alias("corners")),
    ]
    for p in parts:  # one-row frames
        raw = raw.join(F.broadcast(p), how="cross")
    return raw
