"""Statistics of tracks: lengths, distributions, occupancy, runs and trajectories.

observations(keys..., t, individual, x, y, confidence, escape_state): keys name the clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import same_rows
from ..functions.storage import written


def has_position(any_of: bool = False) -> Column:
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    return (x | y) if any_of else (x & y)


def track_lengths(observations: DataFrame, keys: list[str], any_of: bool = False) -> DataFrame:
    """Samples of each individual with both coordinates (or any of them)."""
    return observations.groupBy(*keys, "individual").agg(F.sum(has_position(any_of).cast("long")).alias("n_samples"))


def long_tracks(observations: DataFrame, keys: list[str], least: float, any_of: bool = False) -> DataFrame:
    """Observations of individuals with at least so many samples."""
    kept = track_lengths(observations, keys, any_of).filter(F.col("n_samples") >= least).select(*keys, "individual")
    return observations.join(kept, [*keys, "individual"], "left_semi")


#: Values of a group that a task may hold to sort them, and counts that it keeps instead.
SORTED, BINS = 1 << 16, 1024


def exact_median(df: DataFrame, keys: list[str], column: str, most: int = SORTED, bins: int = BINS) -> DataFrame:
    """keys and median: the middle value, or the mean of the middle two; nulls don't count, and NaN is above all others.

    Where a group has more than `most` values none is sorted. Its values are counted in bins over their range, added up
    before they travel, and the bin with the middle is counted again over its own range, until that is one value. A bin
    keeps the extremes of what is in it, so the result is exact.
    """
    sizes = written(df.groupBy(*keys).agg(F.count(column).alias("n")), "sizes")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
        return df.groupBy(*keys).agg(F.median(column).alias("median"))
    v, inf = F.col("v"), float("inf")
    rows = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))
    ends = rows.filter(~F.isnan(v) & (F.abs(v) < inf)).groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = same_rows(sizes.filter("n > 0"), ends, keys, "left").select(*keys, F.expr("(n - 1) div 2").alias("k1"), F.expr("n div 2").alias("k2"), "lo", "hi")
    out = sizes.filter("n = 0").select(*keys, F.lit(None).cast("double").alias("median"))
    state, first = written(state, "ranges"), True
    while not state.isEmpty():
        span = F.col("hi") - F.col("lo")
        part = F.when(span < inf, (v - F.col("lo")) / F.when(span > 0, span)).otherwise((v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        inner = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * bins), F.lit(bins - 1))
        bin_ = F.when(F.isnan(v), bins + 1).when(v == inf, bins).when(v == -inf, -1).otherwise(inner)
        met = same_rows(rows, state, keys)
        met = met if first else met.filter(v.between(F.col("lo"), F.col("hi")))
        counts = met.groupBy(*keys, "k1", "k2", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("c"))
        holds = lambda k: (F.col(k) >= F.col("before")) & (F.col(k) < F.col("before") + F.col("c"))
        middle = counts.filter(holds("k1") | holds("k2")).groupBy(*keys).agg(
            F.count("*").alias("different"), F.max(F.when(holds("k1"), F.struct("a", "b", "before", "k1", "k2"))).alias("low"), F.max(F.when(holds("k2"), F.col("a"))).alias("above")
        )
        middle = written(middle, "middles", [state])
        same = middle.filter("different = 1")
        out = out.unionByName(middle.filter("different = 2").select(*keys, (F.col("low.b") * 0.5 + F.col("above") * 0.5).alias("median")))
        one = F.col("low.a").eqNullSafe(F.col("low.b"))
        out = out.unionByName(same.filter(one).select(*keys, F.col("low.a").alias("median")))
        state = same.filter(~one).select(*keys, *((F.col(f"low.{k}") - F.col("low.before")).alias(k) for k in ("k1", "k2")), F.col("low.a").alias("lo"), F.col("low.b").alias("hi"))
        state, first = written(state, "ranges"), False
    return out


def confidence_stats(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation, extremes and median of each clip's confidence."""
    c = "confidence"
    stats = observations.groupBy(*keys).agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"))
    return same_rows(stats, exact_median(observations, keys, c), keys).select(*keys, "mean", "std", "min", "max", "median", "n")


def reduced(observations: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean and deviation of a variable over all dimensions but `by`."""
    return observations.groupBy(*by).agg(F.avg(column).alias(f"{column}_mean"), F.stddev_pop(column).alias(f"{column}_std"))


def bin_of(value: Column, low: float, high: float, n: int) -> Column:
    """The bin (from 0) of n equal ones between low and high, the last closed; null outside."""
    step = (high - low) / n
    b = F.least(F.floor((value - F.lit(float(low))) / F.lit(step)).cast("int"), F.lit(n - 1))
    return F.when((value >= low) & (value <= high), b)


def histogram(df: DataFrame, column: str, low: float, high: float, n: int, by: list[str] | None = None) -> DataFrame:
    """Counts of the bins that have a value; values outside are dropped."""
    b = bin_of(F.col(column), low, high, n)
    return df.withColumn("bin", b).filter("bin is not null").groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))


def occupancy(observations: DataFrame, width: float, height: float, nx: int, ny: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts of positions on a grid over the image; ny keeps cells square by default."""
    ny = round(nx * height / width) if ny is None else ny
    bx, by_ = bin_of(F.col("x"), 0, width, nx), bin_of(F.col("y"), 0, height, ny)
    return observations.select(*(by or []), bx.alias("bx"), by_.alias("by")).filter("bx is not null and by is not null").groupBy(*(by or []), "bx", "by").agg(F.count("*").alias("n"))


def occupancy_of_range(observations: DataFrame, keys: list[str], nx: int, ny: int) -> DataFrame:
    """The same on a grid over each group's own extent."""
    ends = observations.filter(has_position()).groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def cell(v: str, a: str, b: str, n: int) -> Column:
        span = F.col(b) - F.col(a)
        return F.when(span == 0, 0).otherwise(F.least(F.floor((F.col(v) - F.col(a)) * n / F.when(span != 0, span)).cast("int"), F.lit(n - 1)))

    return observations.filter(has_position()).join(ends, keys).select(*keys, cell("x", "x0", "x1", nx).alias("bx"), cell("y", "y0", "y1", ny).alias("by")).groupBy(*keys, "bx", "by").agg(F.count("*").alias("n"))


def dense_grid(counts: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells without a count as well; the grid has a fixed size."""
    spark = counts.sparkSession
    cells = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("bx"), F.expr(f"cast(id div {nx} as int)").alias("by"))
    return cells.join(counts, ["bx", "by"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def raster(observations: DataFrame, width: int, height: int) -> DataFrame:
    """Counts of positions by pixel, within the canvas."""
    px, py = F.floor("x").cast("int"), F.floor("y").cast("int")
    inside = (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)
    return observations.filter(has_position()).select(px.alias("px"), py.alias("py")).filter(inside).groupBy("px", "py").agg(F.count("*").alias("n"))


def first_positions(observations: DataFrame, keys: list[str]) -> DataFrame:
    """The first coordinate in time of each kind, nulls left out."""
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("t")))
    return observations.groupBy(*keys, "individual").agg(at("x").alias("x"), at("y").alias("y"))


def run_lengths(series: DataFrame, keys: list[str], value: str, order: str = "t") -> DataFrame:
    """Runs of equal values: run (from 1), value, start, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = series.withColumn("__c", change).withColumn("run", F.sum("__c").over(w))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("start"), F.count("*").alias("length"))


def trajectories(observations: DataFrame, at: DataFrame, keys: list[str], now_in_past: bool = True) -> DataFrame:
    """Past and future positions of individuals at the asked-for times at(keys..., individual, t), which share no frame; the present one is in the past or in the future.

    Each asked-for row gathers one track, so the result grows with what is asked for and not with the
    square of a track; past_future_counts() has the counts of all rows.
    """
    by = [*keys, "individual"]
    point = F.struct("t", "x", "y")
    asked = at.select(*by, F.col("t").alias("__now")).distinct()
    rows = asked.join(observations.select(*by, point.alias("__p")), by)
    t = F.col("__p.t")
    past = t <= F.col("__now") if now_in_past else t < F.col("__now")
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("__p"))))
    return rows.groupBy(*by, F.col("__now").alias("t")).agg(listed(past).alias("past"), listed(~past).alias("future"))


def past_future_counts(observations: DataFrame, keys: list[str]) -> DataFrame:
    """How many positions are past (the present one included) and future, by running counts."""
    w = Window.partitionBy(*keys, "individual").orderBy("t")
    number, total = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys, "individual"))
    return observations.select(*keys, "individual", "t", number.alias("n_past"), (total - number).alias("n_future"))


def running_count(frames: DataFrame, keys: list[str], flag: str, order: str = "frame") -> DataFrame:
    """Numbers the flagged frames (saved pairs) from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    return frames.filter(F.col(flag)).withColumn("pair_count", F.row_number().over(w))


def detection_counts(frames: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("detected"), F.count_if(~F.col(flag)).alias("not_detected"))


def clip_lengths(clips: DataFrame) -> DataFrame:
    """Frames of a clip, before and from the escape; clips of clip_frames()."""
    n = F.col("clip_last_frame_0idx") - F.col("clip_first_frame_0idx") + 1
    escape = F.col("clip_last_frame_0idx") - F.col("escape_start_frame_0idx") + 1
    return clips.select("*", n.alias("clip_length"), escape.alias("escape_length"), (n - escape).alias("outside_length"))


def video_durations(clips: DataFrame, video: str = "video") -> DataFrame:
    """Frames up to the last clip's end, minutes, and hours by the video's own rate."""
    per = clips.groupBy(video).agg(F.max("clip_last_frame_0idx").alias("last"), F.min("fps").alias("fps"), F.count("*").alias("n_clips"))
    return per.select(video, "n_clips", (F.col("last") + 1).alias("n_frames"), ((F.col("last") + 1) / F.col("fps") / 60).alias("minutes"), (F.col("last") / F.col("fps") / 3600).alias("hours"))


def small_videos(clips: DataFrame, n: int, video: str = "video") -> DataFrame:
    return clips.groupBy(video).agg(F.count_distinct("clip").alias("n_clips")).filter(F.col("n_clips") < n)


def escape_type_counts(clips: DataFrame) -> DataFrame:
    return clips.groupBy(F.lower("escape_type").alias("escape_type")).agg(F.count("*").alias("n"))


def select_clips(df: DataFrame, escape_type: str | None = None, video_like: str | None = None, clip: str | None = None, video: str = "video_id", name: str = "clip_id") -> DataFrame:
    """Clips by escape type, videos by a glob, one clip by name; conditions on partition columns prune folders."""
    if escape_type is not None:
        df = df.filter(F.lower("escape_type") == escape_type.lower())
    if video_like is not None:
        df = df.filter(F.col(video).like(video_like.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")))
    return df.filter(F.col(name) == clip) if clip is not None else df


def clip_at(df: DataFrame, index: int, video: str, clip: str) -> DataFrame:
    """The clip with a number (from 0) within each video."""
    return df.withColumn("__r", F.dense_rank().over(Window.partitionBy(video).orderBy(clip)) - 1).filter(F.col("__r") == index).drop("__r")


def time_slice(observations: DataFrame, first: int, last: int) -> DataFrame:
    """Both ends belong to the slice, as labels of an axis do: 0 to 100 are 101 frames."""
    return observations.filter(F.col("t").between(first, last))


def scaled(observations: DataFrame, factor: float, columns: tuple[str, ...] = ("x", "y", "w", "h")) -> DataFrame:
    return observations.withColumns({c: F.col(c) * factor for c in columns})


def individuals_in_and_out(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Individuals seen outside (0) and inside (1) of escapes, each once."""
    side = lambda s: observations.filter((F.col("escape_state") == s) & has_position()).select(*keys, "individual")
    return side(0).union(side(1)).distinct()
