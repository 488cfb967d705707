"""Queries over run trees, lineages across runs, profiles of spans, and network attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contig, lineage, network, observables, profiles
from .registry import BINS, HIGH, LOW, SPANS, Tables, _edges, _r, query

EDGES_ACROSS = """, e AS (SELECT p.run_idx, p.cycle_idx + 1 AS cycle_idx, p.child_idx AS traj_idx, p.run_idx AS p_run, p.cycle_idx AS p_cycle, p.parent_idx AS p_traj FROM parents p JOIN runs r ON r.run_idx = p.run_idx WHERE p.parent_idx >= 0 AND p.cycle_idx + 1 < r.n_cycles
 UNION ALL SELECT k.run_idx, 0, p.child_idx, p.run_idx, p.cycle_idx, p.parent_idx FROM parents p JOIN runs r ON r.run_idx = p.run_idx AND p.cycle_idx = r.n_cycles - 1 JOIN conts k ON k.base_run_idx = p.run_idx WHERE p.parent_idx >= 0)"""
CYCLES = ", c AS (SELECT run_idx, cycle_idx, run_idx AS p_run, cycle_idx - 1 AS p_cycle FROM (SELECT run_idx, unnest(range(1, n_cycles)) AS cycle_idx FROM runs) UNION ALL SELECT r.run_idx, 0, r.base_run_idx, b.n_cycles - 1 FROM runs r JOIN runs b ON b.run_idx = r.base_run_idx)"
OFFSETS = """, o AS (SELECT run_idx, n_cycles, run_idx AS root_run, CAST(0 AS BIGINT) AS "offset" FROM runs WHERE base_run_idx IS NULL
 UNION ALL SELECT r.run_idx, r.n_cycles, o.root_run, o."offset" + o.n_cycles FROM runs r JOIN o ON r.base_run_idx = o.run_idx)"""


@query(f"""{EDGES_ACROSS}, line AS (SELECT f.run_idx AS end_run, f.cycle_idx AS end_cycle, f.traj_idx AS end_traj, f.run_idx, f.cycle_idx, f.traj_idx FROM frames f JOIN runs r ON f.run_idx = r.run_idx AND f.cycle_idx = r.n_cycles - 1
 UNION ALL SELECT l.end_run, l.end_cycle, l.end_traj, e.p_run, e.p_cycle, e.p_traj FROM line l JOIN e ON e.run_idx = l.run_idx AND e.cycle_idx = l.cycle_idx AND e.traj_idx = l.traj_idx) SELECT * FROM line""", recursive=True)
def lineage_contig(t: Tables) -> DataFrame:
    return lineage.tree_lineages(lineage.frame_edges(t.parents, t.runs, t.continuations), t.ends)


@query(f"{OFFSETS}, s AS (SELECT o.run_idx, min(p.cycle_idx) AS c FROM o JOIN parents p ON p.run_idx = o.run_idx GROUP BY 1), up AS (SELECT p.run_idx, p.cycle_idx, p.child_idx AS walker_idx, p.plain_idx AS tree FROM parents p WHERE p.cycle_idx = 0 UNION ALL SELECT p.run_idx, p.cycle_idx, p.child_idx, u.tree FROM up u JOIN parents p ON p.run_idx = u.run_idx AND p.cycle_idx = u.cycle_idx + 1 AND p.plain_idx = u.walker_idx), n AS (SELECT run_idx, walker_idx, tree FROM up UNION ALL SELECT DISTINCT run_idx, tree, tree FROM up) SELECT run_idx, tree, count(*) AS n_nodes FROM n GROUP BY run_idx, tree", recursive=True)
def forest_trees(t: Tables) -> DataFrame:
    return lineage.tree_of(t.plain).groupBy("run_idx", "tree").agg(F.count("*").alias("n_nodes"))


@query(" SELECT run_idx, cycle_idx, count(*) AS n, min(child_idx) AS first, max(child_idx) AS last FROM parents GROUP BY run_idx, cycle_idx UNION ALL SELECT run_idx, -1, count(DISTINCT plain_idx), min(plain_idx), max(plain_idx) FROM parents WHERE cycle_idx = 0 GROUP BY run_idx")
def forest_steps(t: Tables) -> DataFrame:
    nodes, _ = lineage.forest(t.plain.withColumn("plain_idx", F.col("parent_idx")))
    return lineage.forest_steps(nodes).select("run_idx", "cycle_idx", F.size("walkers").cast("long").alias("n"), F.col("walkers")[0].alias("first"), F.element_at("walkers", -1).alias("last"))


@query(""", n AS (SELECT run_idx, cycle_idx, child_idx AS walker_idx FROM parents UNION SELECT run_idx, cycle_idx - 1, plain_idx FROM parents)
 SELECT n.run_idx, n.cycle_idx, n.walker_idx, round(f.weight, 6) AS weight, round(-ln(f.weight), 6) AS free_energy, f.progress, CASE WHEN w.walker_idx IS NULL THEN 'disc' ELSE 'square' END AS shape FROM n
 LEFT JOIN frames f ON f.run_idx = n.run_idx AND f.cycle_idx = n.cycle_idx + 1 AND f.traj_idx = n.walker_idx LEFT JOIN (SELECT DISTINCT run_idx, cycle_idx, walker_idx FROM warping WHERE target_idx = 0) w ON w.run_idx = n.run_idx AND w.cycle_idx = n.cycle_idx AND w.walker_idx = n.walker_idx""")
def forest_node_attributes(t: Tables) -> DataFrame:
    nodes, _ = lineage.forest(t.plain.withColumn("plain_idx", F.col("parent_idx")))
    return _r(lineage.forest_layout_nodes(nodes, t.frames, t.warping.filter("target_idx = 0")), "weight", "free_energy")


@query(" SELECT run_idx, cycle_idx, walker_idx, max(d) AS most FROM (SELECT run_idx, cycle_idx, walker_idx, decision_id AS d FROM res) GROUP BY ALL")
def forest_array_attributes(t: Tables) -> DataFrame:
    levels = t.resampling.groupBy("run_idx", "cycle_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("walker_idx", "decision_id"))), lambda x: x.decision_id).alias("most"))
    nodes = t.resampling.select("run_idx", "cycle_idx", "walker_idx").distinct()
    return lineage.with_node_arrays(nodes, levels, "most")


# run trees


@query(f"{CYCLES} SELECT * FROM c")
def cycle_tree_edges(t: Tables) -> DataFrame:
    return contig.cycle_edges(t.runs)


@query(" SELECT run_idx, CAST(0 AS BIGINT) AS cycle_idx FROM runs WHERE base_run_idx IS NULL")
def tree_roots(t: Tables) -> DataFrame:
    return contig.tree_roots(t.runs)


@query(f"{OFFSETS} SELECT root_run, run_idx, n_cycles - 1 AS cycle_idx FROM o WHERE run_idx NOT IN (SELECT base_run_idx FROM runs WHERE base_run_idx IS NOT NULL)", recursive=True)
def tree_leaves(t: Tables) -> DataFrame:
    return contig.tree_leaves(t.runs)


@query(f"{OFFSETS} SELECT root_run, count(*) AS n_runs, CAST(sum(n_cycles) AS BIGINT) AS n_cycles FROM o GROUP BY root_run", recursive=True)
def tree_components(t: Tables) -> DataFrame:
    return contig.subtrees(t.runs)


@query(f"{OFFSETS} SELECT run_idx, unnest(range(n_cycles)) AS cycle_idx FROM o WHERE root_run = (SELECT root_run FROM o WHERE run_idx = 0)", recursive=True)
def tree_component_cycles(t: Tables) -> DataFrame:
    return contig.subtree_of(t.runs, 0)


@query(f"""{CYCLES}, b AS (SELECT run_idx AS end_run, CAST(5 AS BIGINT) AS end_cycle, run_idx, CAST(5 AS BIGINT) AS cycle_idx FROM runs UNION ALL SELECT b.end_run, b.end_cycle, c.p_run, c.p_cycle FROM b JOIN c ON c.run_idx = b.run_idx AND c.cycle_idx = b.cycle_idx)
 SELECT end_run, end_cycle, count(*) OVER (PARTITION BY end_run) - row_number() OVER (PARTITION BY end_run ORDER BY run_idx DESC, cycle_idx DESC) AS contig_cycle, run_idx, cycle_idx FROM b""", recursive=True)
def branch_trace(t: Tables) -> DataFrame:
    return contig.branch_trace(t.runs, t.runs.select("run_idx", F.lit(5).cast("long").alias("cycle_idx")))


@query(f'{OFFSETS} SELECT f.run_idx, f.traj_idx, f.cycle_idx, o."offset" + f.cycle_idx AS contig_cycle FROM frames f JOIN o ON o.run_idx = f.run_idx WHERE f.cycle_idx % 10 = 0', recursive=True)
def run_to_contig(t: Tables) -> DataFrame:
    return contig.run_to_contig(t.frames.filter("cycle_idx % 10 = 0").select("run_idx", "traj_idx", "cycle_idx"), t.runs)


@query(" SELECT i AS pos, CAST(0 AS BIGINT) AS run_idx, i % 20 AS traj_idx, i * 3 % 45 AS cycle_idx FROM (SELECT unnest(range(60)) AS i)")
def contig_to_run(t: Tables) -> DataFrame:
    trace = t.spark.range(60).select(F.col("id").alias("pos"), (F.col("id") % 20).alias("traj_idx"), (F.col("id") * 3 % 45).alias("contig_cycle"))
    span = contig.contig_trace(t.spans).filter(F.col("span_run") == t.spans.filter("run_idx = 0").agg(F.min("span_run")).first()[0])
    return contig.contig_to_run(trace, span)


@query(f'{SPANS} SELECT s.span_run, s."offset" + p.cycle_idx AS contig_cycle, p.run_idx, p.cycle_idx, p.child_idx, p.parent_idx FROM parents p JOIN spans s ON s.run_idx = p.run_idx', recursive=True)
def trace_parent_table(t: Tables) -> DataFrame:
    return contig.trace_parents(contig.contig_trace(t.spans), t.parents).select("span_run", "contig_cycle", "run_idx", "cycle_idx", "child_idx", "parent_idx")


@query(f"{CYCLES} SELECT a.p_run AS run_0, a.p_cycle AS cycle_0, b.p_run AS run_1, b.p_cycle AS cycle_1, b.run_idx AS run_2, b.cycle_idx AS cycle_2 FROM c b JOIN c a ON a.run_idx = b.p_run AND a.cycle_idx = b.p_cycle")
def tree_cycle_windows(t: Tables) -> DataFrame:
    return contig.tree_cycle_windows(t.runs, 3)


@query(f'{SPANS} SELECT s.span_run, s."offset" + f.cycle_idx AS contig_cycle, f.traj_idx, f.state FROM frames f JOIN spans s ON s.run_idx = f.run_idx', recursive=True)
def contig_fields(t: Tables) -> DataFrame:
    return contig.contig_fields(t.frames, contig.contig_trace(t.spans), ["state"])


@query(f'{SPANS} SELECT s.span_run, s."offset" + f.cycle_idx AS contig_cycle, count(*) AS n_walkers FROM frames f JOIN spans s ON s.run_idx = f.run_idx GROUP BY 1, 2', recursive=True)
def contig_walkers(t: Tables) -> DataFrame:
    return contig.contig_walkers(t.frames, contig.contig_trace(t.spans))


@query(f"{SPANS}{EDGES_ACROSS.replace(' e AS', ' e AS')} SELECT e.p_run AS run_0, e.p_cycle AS cycle_0, e.p_traj AS traj_0, e.run_idx AS run_1, e.cycle_idx AS cycle_1, e.traj_idx AS traj_1 FROM e JOIN spans s ON s.run_idx = e.run_idx JOIN spans b ON b.run_idx = e.p_run AND b.span_run = s.span_run WHERE s.span_run = (SELECT min(span_run) FROM spans)", recursive=True)
def contig_sliding_windows(t: Tables) -> DataFrame:
    first = t.spans.agg(F.min("span_run")).first()[0]
    trace = contig.contig_trace(t.spans.filter(F.col("span_run") == first)).select("run_idx", "cycle_idx")
    edges = lineage.frame_edges(t.parents, t.runs, t.continuations).join(trace, ["run_idx", "cycle_idx"], "left_semi")
    return lineage.sliding_windows(edges, 2)


@query(f'{SPANS} SELECT s.span_run, CAST(count(*) AS BIGINT) AS n_cycles, CAST(sum(p.n) AS BIGINT) AS n_records FROM (SELECT run_idx, cycle_idx, count(DISTINCT walker_idx) AS n FROM res GROUP BY 1, 2) p JOIN spans s ON s.run_idx = p.run_idx GROUP BY 1', recursive=True)
def contig_resampling_panel(t: Tables) -> DataFrame:
    panel = contig.contig_records(lineage.resampling_panel(t.resampling), t.spans)
    return panel.groupBy("span_run").agg(F.countDistinct("contig_cycle").alias("n_cycles"), F.sum(F.size("walkers")).alias("n_records"))


# profiles

HIST = f"CAST(least(floor((progress - {LOW}) / {(HIGH - LOW) / BINS}), {BINS - 1}) AS BIGINT)"
EDGES = [LOW + (HIGH - LOW) * k / BINS for k in range(BINS + 1)]
INSIDE = f"progress BETWEEN {LOW} AND {HIGH}"


def _fe(by: str = "") -> str:
    w = f"PARTITION BY {by}" if by else ""
    return f"round(total, 6) AS total, round(-ln(total) - min(-ln(total)) OVER ({w}), 6) AS free_energy"


@query(f"{SPANS}, h AS (SELECT span_run, {HIST} AS bin, sum(weight) AS total FROM frames f JOIN spans s ON s.run_idx = f.run_idx WHERE {INSIDE} GROUP BY 1, 2) SELECT span_run, bin, {_fe('span_run')} FROM h", recursive=True)
def fe_spans(t: Tables) -> DataFrame:
    return _r(profiles.span_profiles(t.frames, t.spans, "progress", EDGES), "total", "free_energy")


@query(f"{SPANS}, h AS (SELECT {HIST} AS bin, sum(weight) AS total FROM frames f JOIN spans s ON s.run_idx = f.run_idx WHERE {INSIDE} GROUP BY 1) SELECT bin, {_fe()} FROM h", recursive=True)
def fe_all_spans(t: Tables) -> DataFrame:
    return _r(profiles.all_spans_profile(t.frames, t.spans, "progress", EDGES), "total", "free_energy")


@query(f"{SPANS}, h AS (SELECT {HIST} AS bin, sum(weight) AS total FROM frames f JOIN spans s ON s.run_idx = f.run_idx WHERE {INSIDE} AND f.cycle_idx < 40 GROUP BY 1) SELECT bin, {_fe()} FROM h", recursive=True)
def fe_truncated(t: Tables) -> DataFrame:
    return _r(profiles.all_spans_profile(t.frames, t.spans, "progress", EDGES, truncate=40), "total", "free_energy")


@query(f"{SPANS}, h AS (SELECT {HIST} AS bin, sum(weight) AS total FROM frames f JOIN spans s ON s.run_idx = f.run_idx AND s.span_run = f.run_idx AND f.cycle_idx = s.n_cycles - 1 WHERE {INSIDE} GROUP BY 1) SELECT bin, {_fe()} FROM h", recursive=True)
def fe_trace(t: Tables) -> DataFrame:
    return _r(profiles.trace_profile(t.frames, contig.final_trace(t.frames, t.spans), "progress", EDGES), "total", "free_energy")


@query(f'{SPANS}, p AS (SELECT unnest(range(5)) AS part, unnest([30, 60, 90, 120, 200]) AS e), h AS (SELECT part, {HIST} AS bin, sum(weight) AS total FROM frames f JOIN spans s ON s.run_idx = f.run_idx AND s.span_run = (SELECT min(span_run) FROM spans) JOIN p ON s."offset" + f.cycle_idx < p.e WHERE {INSIDE} GROUP BY 1, 2) SELECT part, bin, {_fe("part")} FROM h', recursive=True)
def fe_span_cumulative(t: Tables) -> DataFrame:
    first = t.spans.agg(F.min("span_run")).first()[0]
    return _r(profiles.span_cumulative_profiles(t.frames, t.spans, first, "progress", EDGES, [30, 60, 90, 120, 200]), "total", "free_energy")


@query(f'{SPANS}, n AS (SELECT span_run, sum(n_cycles) AS n FROM spans GROUP BY 1), p AS (SELECT span_run, i AS part, CAST(floor(n / (1 / ((i + 1) * 0.25))) AS BIGINT) AS e FROM n, (SELECT unnest(range(4)) AS i)), h AS (SELECT part, {HIST} AS bin, sum(weight) AS total FROM frames f JOIN spans s ON s.run_idx = f.run_idx JOIN p ON p.span_run = s.span_run AND s."offset" + f.cycle_idx < p.e WHERE {INSIDE} GROUP BY 1, 2) SELECT part, bin, {_fe("part")} FROM h', recursive=True)
def fe_all_percentages(t: Tables) -> DataFrame:
    return _r(profiles.all_cumulative_profiles(t.frames, t.spans, "progress", EDGES, percentages=(0.25, 0.5, 0.75, 1.0)), "total", "free_energy")


@query(f'{SPANS}, n AS (SELECT span_run, sum(n_cycles) AS n FROM spans GROUP BY 1), p AS (SELECT span_run, i AS part, least((i + 1) * 30, n) AS e FROM n, (SELECT unnest(range(100)) AS i) WHERE i * 30 < n), h AS (SELECT part, {HIST} AS bin, sum(weight) AS total FROM frames f JOIN spans s ON s.run_idx = f.run_idx JOIN p ON p.span_run = s.span_run AND s."offset" + f.cycle_idx < p.e WHERE {INSIDE} GROUP BY 1, 2) SELECT part, bin, {_fe("part")} FROM h', recursive=True)
def fe_all_tranches(t: Tables) -> DataFrame:
    return _r(profiles.all_cumulative_profiles(t.frames, t.spans, "progress", EDGES, tranche=30), "total", "free_energy")


@query(" SELECT i AS k, round(a + (b - a) * i / 12, 6) AS edge FROM (SELECT min(progress) AS a, max(progress) AS b, unnest(range(13)) AS i FROM frames WHERE cycle_idx < 50)")
def bin_edges_common(t: Tables) -> DataFrame:
    trees = [t.frames.filter("run_idx % 2 = 0"), t.frames.filter("run_idx % 2 = 1")]
    edges = profiles.common_edges(trees, "progress", 12, truncate=50)
    return _r(t.spark.createDataFrame(list(enumerate(edges)), "k long, edge double"), "edge")


@query(f", h AS (SELECT {HIST} AS bin, sum(weight) AS total FROM frames WHERE {INSIDE} AND progress > 30 GROUP BY 1) SELECT b.bin, round(total, 6) AS total FROM (SELECT unnest(range({BINS})) AS bin) b LEFT JOIN h ON h.bin = b.bin")
def histogram_all_bins(t: Tables) -> DataFrame:
    h = profiles.weighted_histogram(t.frames.filter("progress > 30"), "progress", LOW, HIGH, BINS)
    return _r(profiles.all_bins(h, BINS), "total")


RATES = f"""{SPANS}, z AS (SELECT span_run, sum(n_cycles) AS n FROM spans GROUP BY 1), w AS (SELECT s.span_run, w.target_idx, s."offset" + w.cycle_idx AS c, sum(w.weight) AS w FROM warping w JOIN spans s ON s.run_idx = w.run_idx GROUP BY 1, 2, 3)"""


@query(f"{RATES}, g AS (SELECT d.span_run, d.target_idx, unnest(range(CAST(z.n AS BIGINT))) AS c FROM (SELECT DISTINCT span_run, target_idx FROM w) d JOIN z ON z.span_run = d.span_run), x AS (SELECT g.*, sum(coalesce(w.w, 0)) OVER (PARTITION BY g.span_run, g.target_idx ORDER BY g.c) AS total_weight FROM g LEFT JOIN w ON w.span_run = g.span_run AND w.target_idx = g.target_idx AND w.c = g.c) SELECT span_run, target_idx, c AS contig_cycle, round(total_weight, 6) AS total_weight, round(total_weight / ((c + 1) * 20), 6) AS rate FROM x", recursive=True)
def contig_warp_rates(t: Tables) -> DataFrame:
    return _r(profiles.contig_warp_rates(t.warping, t.spans, profiles.ensemble_sizes(t.frames)), "total_weight", "rate")


@query(f"{RATES} SELECT w.span_run, w.target_idx, CAST(z.n - 1 AS BIGINT) AS contig_cycle, round(sum(w), 6) AS total_weight, round(sum(w) / (z.n * 20), 9) AS rate FROM w JOIN z ON z.span_run = w.span_run GROUP BY w.span_run, w.target_idx, z.n", recursive=True)
def contig_warp_rate_final(t: Tables) -> DataFrame:
    return _r(_r(profiles.contig_warp_rates(t.warping, t.spans, profiles.ensemble_sizes(t.frames), every=False), "total_weight"), "rate", to=9)


SEGMENTS = ", seg AS (SELECT run_idx, cycle_idx, traj_idx % 4 AS worker_idx, progress / 10.0 AS segment_time, cycle_idx * 1.0 AS cycle_time, cycle_idx * 0.5 AS runner_time, 0.25 AS bc_time, cycle_idx * 0.25 AS resampling_time FROM frames)"


def _segments(t: Tables) -> DataFrame:
    c = F.col("cycle_idx")
    return t.frames.select("run_idx", "cycle_idx", (F.col("traj_idx") % 4).alias("worker_idx"), (F.col("progress") / 10.0).alias("segment_time"), (c * 1.0).alias("cycle_time"), (c * 0.5).alias("runner_time"), F.lit(0.25).alias("bc_time"), (c * 0.25).alias("resampling_time"))


@query(f"{SEGMENTS} SELECT worker_idx, round(avg(segment_time), 6) AS mean_segment_time, count(*) AS n_segments FROM seg GROUP BY 1")
def worker_performance(t: Tables) -> DataFrame:
    return _r(profiles.performance(_segments(t))[0], "mean_segment_time")


@query(f"{SEGMENTS} SELECT CAST(round(avg(cycle_time), 6) AS DOUBLE) AS mean_cycle_time, CAST(round(avg(runner_time), 6) AS DOUBLE) AS mean_runner_time, CAST(round(avg(bc_time), 6) AS DOUBLE) AS mean_bc_time, CAST(round(avg(resampling_time), 6) AS DOUBLE) AS mean_resampling_time FROM (SELECT DISTINCT run_idx, cycle_idx, cycle_time, runner_time, bc_time, resampling_time FROM seg)")
def cycle_performance(t: Tables) -> DataFrame:
    out = profiles.performance(_segments(t))[1]
    return _r(out.select(*(F.col(c).cast("double").alias(c) for c in out.columns)), *out.columns)


@query(" SELECT f.run_idx, round(coalesce(w.w, 0) / f.n, 9) AS rate FROM (SELECT run_idx, count(*) AS n FROM frames GROUP BY 1) f LEFT JOIN (SELECT run_idx, sum(weight) AS w FROM warping GROUP BY 1) w ON w.run_idx = f.run_idx")
def crossing_rate(t: Tables) -> DataFrame:
    return _r(profiles.crossing_rate(t.frames, t.warping), "rate", to=9)


@query(" SELECT run_idx, cycle_idx, CAST((cycle_idx + 1) * 0.002 * 1000 AS DOUBLE) AS walker_time, CAST((cycle_idx + 1) * 20 * 0.002 * 1000 AS DOUBLE) AS total_time FROM (SELECT DISTINCT run_idx, cycle_idx FROM frames)")
def sampling_times(t: Tables) -> DataFrame:
    return _r(profiles.sampling_times(t.frames, 0.002, 1000), "walker_time", "total_time")


WALK = ", walk AS (SELECT run_idx, cycle_idx, weight, unnest([CAST(floor(progress / 10) AS BIGINT), cycle_idx % 7]) AS x, unnest([0, 1]) AS dim FROM frames)"


def _walk(t: Tables) -> DataFrame:
    return t.frames.withColumn("positions", F.array(F.floor(F.col("progress") / 10).cast("long"), F.col("cycle_idx") % 7))


@query(f"{WALK} SELECT CAST(dim AS BIGINT) AS dim, max(x) AS most FROM walk WHERE run_idx = 0 GROUP BY dim UNION ALL SELECT NULL, max(x) FROM walk WHERE run_idx = 0")
def walk_largest_range(t: Tables) -> DataFrame:
    return profiles.largest_range(_walk(t), 0)


OCCUPANCY = f"{WALK}, occ AS (SELECT x, sum(weight) / ((SELECT count(DISTINCT cycle_idx) FROM frames WHERE run_idx = 0) * 2) AS p FROM walk WHERE run_idx = 0 GROUP BY x)"


@query(f"{OCCUPANCY} SELECT x, round(p, 9) AS probability FROM occ")
def walk_occupancy(t: Tables) -> DataFrame:
    return _r(profiles.occupancy(_walk(t), 0), "probability", to=9)


@query(f"{OCCUPANCY}, q AS (SELECT ln(p) AS p, ln((1 - 1.0 / 3) * pow(1.0 / 3, x)) AS e FROM occ) SELECT round(sum(CASE WHEN p > 2 * e THEN 1 + abs(e - p) / e ELSE 0 END), 6) AS accuracy FROM q")
def walk_accuracy(t: Tables) -> DataFrame:
    from ..functions.systems import walk_target

    return _r(profiles.occupancy_accuracy(profiles.occupancy(_walk(t), 0), lambda x: walk_target(x, 0.25)), "accuracy")


# networks


@query(" SELECT f.state AS source, g.state AS target, count(*) AS n, round(min(f.weight), 6) AS least, round(max(f.weight), 6) AS most FROM parents p JOIN frames f ON f.run_idx = p.run_idx AND f.cycle_idx = p.cycle_idx AND f.traj_idx = p.parent_idx JOIN frames g ON g.run_idx = p.run_idx AND g.cycle_idx = p.cycle_idx + 1 AND g.traj_idx = p.child_idx WHERE p.parent_idx >= 0 GROUP BY 1, 2")
def edge_weight_lists(t: Tables) -> DataFrame:
    rows = network.edge_weights(t.frames, lineage.sliding_windows(t.edges, 2), 2)
    return _r(rows.groupBy("source", "target").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most")), "least", "most")


@query(" SELECT 's' || CAST(cycle_idx % 3 AS VARCHAR) AS state, count(*) AS n, round(sum(weight), 6) AS weight FROM frames GROUP BY 1")
def explicit_assignments(t: Tables) -> DataFrame:
    given = t.frames.select("run_idx", "cycle_idx", "traj_idx", F.concat(F.lit("s"), (F.col("cycle_idx") % 3).cast("string")).alias("state"))
    return _r(network.assigned(t.frames, given).groupBy("state").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "weight")


@query(" SELECT state AS node_id, round(avg(progress), 6) AS observable_progress, [count(*), max(cycle_idx)] AS layout_grid FROM frames GROUP BY state")
def node_observables(t: Tables) -> DataFrame:
    values = t.frames.groupBy(F.col("state").alias("node_id")).agg(F.avg("progress").alias("value"))
    places = t.frames.groupBy(F.col("state").alias("node_id")).agg(F.array(F.count("*"), F.max("cycle_idx")).alias("value"))
    out = network.with_layout(network.with_observable(network.nodes(t.frames), values, "progress"), places, "grid")
    assert network.named(out, "observable") == ["progress"] and network.named(out, "layout") == ["grid"]
    return _r(out.select("node_id", "observable_progress", "layout_grid"), "observable_progress")


@query(" SELECT state AS node_id, count(*) AS n, round(sum(progress * weight) / sum(weight), 6) AS mean FROM frames GROUP BY state")
def node_map(t: Tables) -> DataFrame:
    of = lambda _, x: {"n": len(x), "mean": float((x.progress * x.weight).sum() / x.weight.sum())}
    return _r(network.node_map(t.frames, of, ["progress", "weight"], "n long, mean double"), "mean")


@query(" SELECT state AS node_id, count(*) AS num_samples FROM frames WHERE state = 'error' GROUP BY state")
def node_attribute(t: Tables) -> DataFrame:
    return network.attributes_of(network.nodes(t.frames), {"node_id": "error"}, "num_samples")


COUNTED = ", k AS (SELECT traj_idx % 4 AS source, cycle_idx % 6 AS target, count(*) AS n FROM frames WHERE run_idx = 0 AND cycle_idx % 6 <> 3 GROUP BY 1, 2)"


@query(f"{COUNTED} SELECT i, j, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j) LEFT JOIN k ON source = i AND target = j")
def counts_dict_matrix(t: Tables) -> DataFrame:
    k = t.frames.filter("run_idx = 0 AND cycle_idx % 6 <> 3").groupBy((F.col("traj_idx") % 4).alias("source"), (F.col("cycle_idx") % 6).alias("target")).agg(F.count("*").alias("n"))
    return network.counts_matrix(k)


@query(" SELECT f.state AS source, g.state AS target, count(*) AS n FROM frames f JOIN frames g ON f.run_idx = g.run_idx AND f.traj_idx = g.traj_idx AND g.cycle_idx = f.cycle_idx + 5 WHERE f.run_idx = 0 GROUP BY 1, 2")
def run_transition_counts(t: Tables) -> DataFrame:
    own = t.frames.select("run_idx", "traj_idx", "cycle_idx", "state")
    moves = own.filter("cycle_idx < 95").select("run_idx", F.col("traj_idx").alias("s_traj"), F.col("cycle_idx").alias("s_cycle"), F.col("traj_idx").alias("t_traj"), (F.col("cycle_idx") + 5).alias("t_cycle"))
    return network.run_counts(own, moves, 0)


@query(" SELECT state AS node_id, count(*) AS n, round(sum(progress), 4) AS total FROM frames WHERE state IN ('error', 'click') GROUP BY state")
def states_fields(t: Tables) -> DataFrame:
    rows = network.node_frames(t.frames, ["error", "click"], ["progress"])
    return _r(rows.groupBy("node_id").agg(F.count("*").alias("n"), F.sum("progress").alias("total")), "total", to=4)


@query(" SELECT n.i, m.i AS j, CAST(e.c AS DOUBLE) AS value FROM (SELECT f.state AS s, g.state AS t, count(*) AS c FROM parents p JOIN frames f ON f.run_idx = p.run_idx AND f.cycle_idx = p.cycle_idx AND f.traj_idx = p.parent_idx JOIN frames g ON g.run_idx = p.run_idx AND g.cycle_idx = p.cycle_idx + 1 AND g.traj_idx = p.child_idx WHERE p.parent_idx >= 0 GROUP BY 1, 2) e JOIN (SELECT state, row_number() OVER (ORDER BY min((run_idx, traj_idx, cycle_idx))) - 1 AS i FROM frames GROUP BY state) n ON n.state = e.s JOIN (SELECT state, row_number() OVER (ORDER BY min((run_idx, traj_idx, cycle_idx))) - 1 AS i FROM frames GROUP BY state) m ON m.state = e.t")
def sparse_matrix(t: Tables) -> DataFrame:
    return network.cells(_edges(t, 2), network.nodes(t.frames), "unweighted_counts")


@query(" SELECT run_idx, traj_idx, round(sum(progress), 4) AS total FROM frames WHERE run_idx = 0 AND traj_idx IN (1, 3) GROUP BY 1, 2")
def traj_fields_map(t: Tables) -> DataFrame:
    chosen = t.spark.createDataFrame([(0, 1), (0, 3)], "run_idx long, traj_idx long")
    rows = t.frames.join(F.broadcast(chosen), ["run_idx", "traj_idx"], "left_semi")
    values = observables.compute_observable(rows, lambda x: x.progress * 1.0, ["progress"], "p")
    return _r(values.groupBy("run_idx", "traj_idx").agg(F.sum("p").alias("total")), "total", to=4)
