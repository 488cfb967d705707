"""Weighted histograms and free energies, warp rates, and per-cycle summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_edges(values: DataFrame, field: str, bins: int | str = "auto") -> list[float]:
    """Edges of equally wide bins between least and greatest value; "auto": the larger of Sturges' and Freedman-Diaconis' numbers."""
    r = values.agg(F.min(field).alias("a"), F.max(field).alias("b"), F.count(field).alias("n"), F.percentile_approx(field, F.array(F.lit(0.25), F.lit(0.75)), 100_000).alias("q")).first()
    if not r.n:
        return [0.0, 1.0]
    a, b = (float(r.a), float(r.b)) if r.b > r.a else (float(r.a) - 0.5, float(r.a) + 0.5)
    if bins == "auto":
        width = 2 * (r.q[1] - r.q[0]) / r.n ** (1 / 3)
        bins = max(math.ceil(math.log2(r.n) + 1), math.ceil((b - a) / width) if width > 0 else 1)
    return [a + (b - a) * k / bins for k in range(bins + 1)]


def bin_of(field: Column, low: float, high: float, bins: int) -> Column:
    """0 .. bins - 1; the last bin holds its right edge; null outside."""
    k = F.floor((field - F.lit(low)) / F.lit((high - low) / bins))
    return F.when((field >= low) & (field <= high), F.least(k, F.lit(bins - 1))).cast("long")


def weighted_histogram(frames: DataFrame, field: str, low: float, high: float, bins: int, by: list[str] | None = None, weight: str = "weight") -> DataFrame:
    """(by ..., bin, total): only bins that hold something."""
    k = bin_of(F.col(field), low, high, bins)
    return frames.withColumn("bin", k).filter("bin is not null").groupBy(*(by or []), "bin").agg(F.sum(weight).alias("total"))


def free_energy(histogram: DataFrame, by: list[str] | None = None, most: float | None = None) -> DataFrame:
    """free_energy = -ln(share), shifted so that the least is 0. Bins without weight have no row; above ``most`` it is null."""
    w = Window.partitionBy(*(by or [F.lit(0)]))  # a row for each bin
    f = -F.log(F.col("total") / F.sum("total").over(w))
    out = histogram.filter("total > 0").withColumn("f", f).withColumn("free_energy", F.col("f") - F.min("f").over(w)).drop("f")
    return out if most is None else out.withColumn("free_energy", F.when(F.col("free_energy") <= most, F.col("free_energy")))


def all_bins(histogram: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """A row for each bin, null where it holds nothing."""
    groups = histogram.select(*by).distinct() if by else histogram.sparkSession.range(1)
    spine = groups.select(*(by or []), F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<long>")).alias("bin"))
    return spine.join(histogram, [*(by or []), "bin"], "left")


def common_edges(trees: list[DataFrame], field: str, bins: int | str = "auto", truncate: int | None = None) -> list[float]:
    """Bin edges over the frames of several trees together, those of cycles before ``truncate`` only."""
    rows = [truncated(t.select("run_idx", "cycle_idx", field), truncate).select(field) for t in trees]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return bin_edges(out, field, bins)


def truncated(frames: DataFrame, cycles: int | None) -> DataFrame:
    """Frames of the first ``cycles`` cycles of each run; None: all."""
    return frames if cycles is None else frames.filter(F.col("cycle_idx") < cycles)


def trace_profile(frames: DataFrame, trace: DataFrame, field: str, edges: list[float], truncate: int | None = None) -> DataFrame:
    """(bin, total, free_energy) over a trace (run_idx, traj_idx, cycle_idx); a frame counts as often as it is in the trace."""
    rows = truncated(trace.join(frames, ["run_idx", "traj_idx", "cycle_idx"]), truncate)
    return free_energy(weighted_histogram(rows, field, edges[0], edges[-1], len(edges) - 1))


def _along(frames: DataFrame, span_rows: DataFrame, truncate: int | None) -> DataFrame:
    return truncated(frames, truncate).join(span_rows.select("span_run", "run_idx", "offset"), "run_idx").withColumn("contig_cycle", F.col("offset") + F.col("cycle_idx"))


def span_profiles(frames: DataFrame, span_rows: DataFrame, field: str, edges: list[float], truncate: int | None = None) -> DataFrame:
    """(span_run, bin, total, free_energy) of each span."""
    rows = _along(frames, span_rows, truncate)
    return free_energy(weighted_histogram(rows, field, edges[0], edges[-1], len(edges) - 1, ["span_run"]), ["span_run"])


def all_spans_profile(frames: DataFrame, span_rows: DataFrame, field: str, edges: list[float], truncate: int | None = None) -> DataFrame:
    """(bin, total, free_energy) over all spans one after the other: frames of a shared trunk count once for each span.

    A run's frames are summed once, and the sums multiplied by the number of spans that it is in.
    """
    times = span_rows.groupBy("run_idx").agg(F.count("*").alias("n"))
    sums = weighted_histogram(truncated(frames, truncate), field, edges[0], edges[-1], len(edges) - 1, ["run_idx"])
    return free_energy(sums.join(times, "run_idx").groupBy("bin").agg(F.sum(F.col("total") * F.col("n")).alias("total")))


def prefix_ends(n_cycles: int, partitions: int = 5) -> list[int]:
    """Ends of growing prefixes: n // k * (i + 1); what is left over goes to the first end only."""
    size, rest = divmod(n_cycles, partitions)
    return [size * (i + 1) + (rest if i == 0 else 0) for i in range(partitions)]


def tranche_ends(n_cycles: int, tranche: int) -> list[int]:
    """Ends of prefixes that grow by ``tranche`` cycles; the last one holds all."""
    return [*range(tranche, n_cycles, tranche), n_cycles] if n_cycles else []


def percentage_ends(n_cycles: int, percentages: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> list[int]:
    """Ends of prefixes of given shares of the cycles."""
    return [int(n_cycles // (1 / p)) for p in percentages]


def partition_ends(n_cycles: int, tranche: int | None = None, partitions: int = 5, percentages: tuple[float, ...] | None = None) -> list[int]:
    """Percentages if given, else tranches if given, else a number of partitions."""
    return percentage_ends(n_cycles, percentages) if percentages else tranche_ends(n_cycles, tranche) if tranche else prefix_ends(n_cycles, partitions)


def cumulative_histograms(frames: DataFrame, field: str, low: float, high: float, bins: int, ends: list[int], cycle: str = "cycle_idx", by: list[str] | None = None) -> DataFrame:
    """(by ..., part, bin, total) for frames of cycles before ends[part].

    Frames are summed by cycle ranges between ends first; a range's sums, not its frames, become a row for each prefix.
    """
    cuts = sorted(set(ends))
    stretch = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        stretch = F.when(F.col(cycle) < cuts[k], k).otherwise(stretch)
    rows = weighted_histogram(frames.withColumn("stretch", stretch).filter(F.col("stretch") < len(cuts)), field, low, high, bins, [*(by or []), "stretch"])
    parts = F.filter(F.array(*(F.struct(F.lit(i).cast("long").alias("part"), F.lit(cuts.index(e)).alias("upto")) for i, e in enumerate(ends))), lambda p: F.col("stretch") <= p.upto)
    return rows.select(*(by or []), "bin", "total", F.explode(parts).alias("p")).groupBy(*(by or []), F.col("p.part").alias("part"), "bin").agg(F.sum("total").alias("total"))


def span_cumulative_profiles(frames: DataFrame, span_rows: DataFrame, span_run: int, field: str, edges: list[float], ends: list[int], truncate: int | None = None) -> DataFrame:
    """(part, bin, total, free_energy) for growing prefixes of one span, by contig cycle."""
    rows = _along(frames, span_rows.filter(F.col("span_run") == span_run), truncate)
    return free_energy(cumulative_histograms(rows, field, edges[0], edges[-1], len(edges) - 1, ends, "contig_cycle"), ["part"])


def all_cumulative_profiles(frames: DataFrame, span_rows: DataFrame, field: str, edges: list[float], truncate: int | None = None, **how) -> DataFrame:
    """(part, bin, total, free_energy) over all spans; each span is cut by its own number of cycles (``partition_ends``)."""
    sizes = span_rows.groupBy("span_run").agg(F.sum(F.least("n_cycles", F.lit(truncate)) if truncate is not None else F.col("n_cycles")).alias("n"))
    lengths = [r.n for r in sizes.select("n").distinct().collect()]  # different lengths of spans, not spans
    ends_of = F.create_map(*(x for n in lengths for x in (F.lit(n), F.array(*(F.lit(e) for e in partition_ends(n, **how))))))
    ends = sizes.select("span_run", F.posexplode(ends_of[F.col("n")]).alias("part", "end"))
    by_cycle = _along(frames, span_rows, truncate)
    sums = weighted_histogram(by_cycle, field, edges[0], edges[-1], len(edges) - 1, ["span_run", "contig_cycle"])
    rows = sums.join(ends, "span_run").filter(F.col("contig_cycle") < F.col("end"))
    return free_energy(rows.groupBy(F.col("part").cast("long").alias("part"), "bin").agg(F.sum("total").alias("total")), ["part"])


def warp_rates(warping: DataFrame, total_time: float) -> DataFrame:
    """(target_idx, total_weight, rate): targets without warps have no row."""
    return warping.groupBy("target_idx").agg(F.sum("weight").alias("total_weight")).withColumn("rate", F.col("total_weight") / F.lit(total_time))


def warp_rates_by_cycle(warping: DataFrame, sizes: DataFrame, cycle_time: float = 1.0) -> DataFrame:
    """(run_idx, target_idx, cycle_idx, total_weight, rate): warps up to each cycle over (cycle + 1) * cycle_time * n_walkers.

    sizes: (run_idx, n_cycles, n_walkers). A target's rows begin at cycle 0 of each run that it occurs in.
    """
    spine = warping.select("run_idx", "target_idx").distinct().join(sizes, "run_idx").select("run_idx", "target_idx", "n_walkers", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cycles") - 1)).alias("cycle_idx"))
    w = warping.groupBy("run_idx", "target_idx", "cycle_idx").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("run_idx", "target_idx").orderBy("cycle_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = spine.join(w, ["run_idx", "target_idx", "cycle_idx"], "left").withColumn("total_weight", F.sum(F.coalesce("w", F.lit(0.0))).over(order))
    return rows.select("run_idx", "target_idx", "cycle_idx", "total_weight", (F.col("total_weight") / ((F.col("cycle_idx") + 1) * cycle_time * F.col("n_walkers"))).alias("rate"))


def ensemble_sizes(frames: DataFrame) -> DataFrame:
    return frames.groupBy("run_idx").agg((F.max("cycle_idx") + 1).alias("n_cycles"), F.countDistinct("traj_idx").alias("n_walkers"))


def weight_summary(frames: DataFrame) -> DataFrame:
    return frames.groupBy("run_idx", "cycle_idx").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.count("*").alias("n_walkers"))


def progress_summary(frames: DataFrame, warping: DataFrame, field: str = "progress") -> DataFrame:
    """Per cycle: least, greatest and mean progress, and running numbers of segments, crossings and crossed weight."""
    order = Window.partitionBy("run_idx").orderBy("cycle_idx").rowsBetween(Window.unboundedPreceding, 0)
    own = frames.groupBy("run_idx", "cycle_idx").agg(F.min(field).alias("least"), F.max(field).alias("most"), F.avg(field).alias("mean"), F.count("*").alias("n"))
    crossed = warping.groupBy("run_idx", "cycle_idx").agg(F.count("*").alias("k"), F.sum("weight").alias("w"))
    rows = own.join(crossed, ["run_idx", "cycle_idx"], "left").na.fill({"k": 0, "w": 0.0})
    return rows.select("run_idx", "cycle_idx", "least", "most", "mean", F.sum("n").over(order).alias("n_segments"), F.sum("k").over(order).alias("n_crossings"), F.sum("w").over(order).alias("crossed_weight"))


def decision_percentages(resampling: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, cloned, merged): shares of walkers that clone, and that are squashed or merged into, in percent."""
    share = lambda *ids: F.count_if(F.col("decision_id").isin(*ids)) * 100.0 / F.count("*")
    return resampling.groupBy("run_idx", "cycle_idx").agg(share(2).alias("cloned"), share(3, 4).alias("merged"))


def contig_warp_rates(warping: DataFrame, span_rows: DataFrame, walkers: DataFrame, cycle_time: float = 1.0, every: bool = True) -> DataFrame:
    """(span_run, target_idx, contig_cycle, total_weight, rate): warps of a span up to each cycle over (cycle + 1) * cycle_time * n_walkers.

    walkers: (run_idx, n_walkers). Earlier runs' cycles count. every=False: the last cycle of each span only.
    """
    w = warping.join(span_rows.select("span_run", "run_idx", "offset"), "run_idx").withColumn("contig_cycle", F.col("offset") + F.col("cycle_idx"))
    sums = w.groupBy("span_run", "target_idx", "contig_cycle").agg(F.sum("weight").alias("w"))
    length = span_rows.groupBy("span_run").agg(F.sum("n_cycles").alias("n")).join(walkers.select(F.col("run_idx").alias("span_run"), "n_walkers"), "span_run")
    rate = (F.col("total_weight") / ((F.col("contig_cycle") + 1) * cycle_time * F.col("n_walkers"))).alias("rate")
    if not every:
        total = sums.groupBy("span_run", "target_idx").agg(F.sum("w").alias("total_weight")).join(length, "span_run").withColumn("contig_cycle", F.col("n") - 1)
        return total.select("span_run", "target_idx", "contig_cycle", "total_weight", rate)
    spine = sums.select("span_run", "target_idx").distinct().join(length, "span_run").select("span_run", "target_idx", "n_walkers", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("contig_cycle"))
    order = Window.partitionBy("span_run", "target_idx").orderBy("contig_cycle").rowsBetween(Window.unboundedPreceding, 0)
    rows = spine.join(sums, ["span_run", "target_idx", "contig_cycle"], "left").withColumn("total_weight", F.sum(F.coalesce("w", F.lit(0.0))).over(order))
    return rows.select("span_run", "target_idx", "contig_cycle", "total_weight", rate)


def performance(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(worker_idx, mean_segment_time, n_segments), and the means of cycle_time, runner_time, bc_time, resampling_time over cycles.

    segments: run_idx, cycle_idx, worker_idx, segment_time and the cycle's four times, a row for each segment.
    """
    workers = segments.groupBy("worker_idx").agg(F.avg("segment_time").alias("mean_segment_time"), F.count("*").alias("n_segments"))
    times = ["cycle_time", "runner_time", "bc_time", "resampling_time"]
    cycles = segments.groupBy("run_idx", "cycle_idx").agg(*(F.max(t).alias(t) for t in times))
    return workers, cycles.agg(*(F.avg(t).alias(f"mean_{t}") for t in times))


def crossing_rate(frames: DataFrame, warping: DataFrame) -> DataFrame:
    """(run_idx, rate): crossed weight over the number of walker segments."""
    n = frames.groupBy("run_idx").agg(F.count("*").alias("n"))
    w = warping.groupBy("run_idx").agg(F.sum("weight").alias("w"))
    return n.join(w, "run_idx", "left").select("run_idx", (F.coalesce("w", F.lit(0.0)) / F.col("n")).alias("rate"))


def distance_summary(pairs: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, mean, least, most) of positive distances between walkers, each pair once."""
    return pairs.filter("distance > 0").groupBy("run_idx", "cycle_idx").agg(F.avg("distance").alias("mean"), F.min("distance").alias("least"), F.max("distance").alias("most"))


def sampling_times(frames: DataFrame, step_time: float, steps: int) -> DataFrame:
    """(run_idx, cycle_idx, walker_time, total_time): simulated time of a walker, and of all of them, up to each cycle."""
    order = Window.partitionBy("run_idx").orderBy("cycle_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.groupBy("run_idx", "cycle_idx").agg(F.count("*").alias("n"))
    return rows.select("run_idx", "cycle_idx", (F.count("*").over(order) * step_time * steps).alias("walker_time"), (F.sum("n").over(order) * step_time * steps).alias("total_time"))


def largest_range(frames: DataFrame, run_idx: int, positions: str = "positions") -> DataFrame:
    """(dim, most): the largest position in each dimension of a run; dim null: in any."""
    rows = frames.filter(F.col("run_idx") == run_idx).select(F.posexplode(positions).alias("dim", "x"))
    return rows.rollup("dim").agg(F.max("x").alias("most")).withColumn("dim", F.col("dim").cast("long"))


def occupancy(frames: DataFrame, run_idx: int, positions: str = "positions") -> DataFrame:
    """(x, probability): weight at each integer position, over the number of cycles and dimensions."""
    own = frames.filter(F.col("run_idx") == run_idx)
    size = own.agg(F.countDistinct("cycle_idx").alias("c"), F.max(F.size(positions)).alias("d")).first()
    rows = own.select("weight", F.explode(positions).alias("x")).groupBy(F.col("x").cast("long").alias("x"))
    return rows.agg((F.sum("weight") / F.lit(float(max((size.c or 0) * (size.d or 0), 1)))).alias("probability"))


def occupancy_accuracy(found: DataFrame, expected) -> DataFrame:
    """(accuracy): over positions x with P(x) above expected(x) squared, the sum of 1 + |ln expected - ln P| / ln expected.

    found: x, probability. expected: Column -> Column, the stationary probability.
    """
    p, e = F.log("probability"), F.log(expected(F.col("x")))
    term = F.when((F.col("probability") > 0) & (p > 2 * e), 1 + F.abs(e - p) / F.nullif(e, F.lit(0.0))).otherwise(F.lit(0.0))
    return found.agg(F.sum(term).alias("accuracy"))
