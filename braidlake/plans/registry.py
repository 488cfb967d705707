"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can.

The tables of a weighted-ensemble store come from ``events`` by ``sources.adapter``. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, topology
from ..operators import contig, lineage, network, observables, profiles, resampling
from ..sources import adapter, catalog

TARGETS = (0,)
WALKERS = 20
LOW, HIGH, BINS = 0.0, 100.0, 20
PARTS = [20, 40, 60, 80, 100]


class Tables:
    """The adapter's tables and what is derived from them, as lazy plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.frames = adapter.frames(spark, sf_dir)
        self.resampling = adapter.resampling(self.frames)
        self.warping = adapter.warping(self.frames)
        self.continuations = adapter.continuations(self.frames)
        self.plain = lineage.net_parents(self.resampling)
        self.parents = lineage.broken(self.plain, self.warping, TARGETS)
        self.edges = lineage.frame_edges(self.parents)

    @property
    def runs(self) -> DataFrame:
        return contig.run_table(self.frames, self.continuations)

    @property
    def spans(self) -> DataFrame:
        return contig.spans(self.runs)

    @property
    def ends(self) -> DataFrame:
        last = self.frames.groupBy("run_idx").agg(F.max("cycle_idx").alias("cycle_idx"))
        return self.frames.join(last, ["run_idx", "cycle_idx"]).select("run_idx", "cycle_idx", "traj_idx")

    @property
    def images(self) -> DataFrame:
        """Vectors as images of walkers: 20 to an ensemble."""
        e = self.spark.read.parquet(f"{self.dir}/embeddings.parquet")
        return e.select(F.floor(F.col("vec_id") / WALKERS).cast("long").alias("run_idx"), F.lit(0).cast("long").alias("cycle_idx"), (F.col("vec_id") % WALKERS).alias("traj_idx"), F.col("embedding").cast("array<double>").alias("image"), F.col("label").cast("long").alias("label"), ((F.col("vec_id") % 7 + 1) / 400.0).alias("weight"), F.lit(1).cast("long").alias("copies"))


def _r(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, recursive: bool = False):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{adapter.CTE.strip()}{oracle}"
        return f

    return add


# scans, traces, records


@query(" SELECT run_idx, traj_idx, count(*) AS n_frames, max(cycle_idx) + 1 AS n_cycles FROM frames GROUP BY run_idx, traj_idx")
def traj_index(t: Tables) -> DataFrame:
    return t.frames.groupBy("run_idx", "traj_idx").agg(F.count("*").alias("n_frames"), (F.max("cycle_idx") + 1).alias("n_cycles"))


@query(", trace AS (SELECT (run_idx * 100 + cycle_idx) * 20 + traj_idx AS pos, run_idx, (traj_idx * 7 + 3) % 20 AS traj_idx, cycle_idx FROM frames WHERE cycle_idx % 5 = 0) SELECT t.pos, t.run_idx, t.traj_idx, t.cycle_idx, f.state, round(f.weight, 6) AS weight FROM trace t LEFT JOIN frames f ON f.run_idx = t.run_idx AND f.traj_idx = t.traj_idx AND f.cycle_idx = t.cycle_idx")
def trace_fields(t: Tables) -> DataFrame:
    pos = (F.col("run_idx") * 100 + F.col("cycle_idx")) * 20 + F.col("traj_idx")
    trace = t.frames.filter("cycle_idx % 5 = 0").select(pos.alias("pos"), "run_idx", ((F.col("traj_idx") * 7 + 3) % 20).alias("traj_idx"), "cycle_idx")
    return _r(contig.trace_fields(t.frames, trace, ["state", "weight"]), "weight")


@query(" SELECT run_idx, traj_idx, cycle_idx, CASE WHEN cycle_idx % 10 = 0 THEN progress END AS sparse FROM frames")
def field_masked_sparse(t: Tables) -> DataFrame:
    values = t.frames.filter("cycle_idx % 10 = 0").select("run_idx", "traj_idx", "cycle_idx", F.col("progress").alias("sparse"))
    return observables.attach(t.frames.select("run_idx", "traj_idx", "cycle_idx"), values, "sparse").withColumnRenamed("observables_sparse", "sparse")


@query(" SELECT run_idx, cycle_idx, count(DISTINCT walker_idx) AS n_walkers, count(*) FILTER (decision_id = 2) AS n_clone_targets, CAST(sum(target_idx) AS BIGINT) AS targets FROM res GROUP BY run_idx, cycle_idx")
def resampling_panel(t: Tables) -> DataFrame:
    panel = lineage.resampling_panel(t.resampling)
    clones = F.expr("CAST(aggregate(walkers, 0, (a, w) -> a + CASE WHEN w.decision_id = 2 THEN size(w.target_idxs) ELSE 0 END) AS LONG)")
    return panel.select("run_idx", "cycle_idx", F.size("walkers").cast("long").alias("n_walkers"), clones.alias("n_clone_targets"), F.expr("aggregate(flatten(walkers.target_idxs), 0L, (a, x) -> a + x)").alias("targets"))


# lineage


@query(" SELECT run_idx, cycle_idx, child_idx, plain_idx AS parent_idx FROM parents")
def parent_edges(t: Tables) -> DataFrame:
    return t.plain


@query(" SELECT run_idx, cycle_idx, child_idx, parent_idx FROM parents")
def parent_edges_discontinuous(t: Tables) -> DataFrame:
    return t.parents


LINE = """, line AS (SELECT f.run_idx, f.cycle_idx AS end_cycle, f.traj_idx AS end_traj, f.cycle_idx, f.traj_idx FROM frames f JOIN (SELECT run_idx, max(cycle_idx) AS c FROM frames GROUP BY run_idx) m ON f.run_idx = m.run_idx AND f.cycle_idx = m.c
 UNION ALL SELECT l.run_idx, l.end_cycle, l.end_traj, p.cycle_idx, p.parent_idx FROM line l JOIN parents p ON p.run_idx = l.run_idx AND p.cycle_idx = l.cycle_idx - 1 AND p.child_idx = l.traj_idx WHERE p.parent_idx >= 0)"""


@query(f"{LINE} SELECT * FROM line", recursive=True)
def lineage_final(t: Tables) -> DataFrame:
    return lineage.ancestors(t.parents, t.ends)


@query(f"{LINE} SELECT run_idx, end_cycle, end_traj, min(cycle_idx) AS root_cycle, arg_min(traj_idx, cycle_idx) AS root_traj FROM line GROUP BY run_idx, end_cycle, end_traj", recursive=True)
def lineage_root(t: Tables) -> DataFrame:
    return lineage.roots_of(t.parents, t.ends)


@query(" SELECT a.run_idx AS run_0, a.cycle_idx AS cycle_0, a.parent_idx AS traj_0, a.run_idx AS run_1, b.cycle_idx AS cycle_1, b.parent_idx AS traj_1, a.run_idx AS run_2, b.cycle_idx + 1 AS cycle_2, b.child_idx AS traj_2 FROM parents a JOIN parents b ON a.run_idx = b.run_idx AND a.cycle_idx = b.cycle_idx - 1 AND a.child_idx = b.parent_idx JOIN frames f ON f.run_idx = b.run_idx AND f.cycle_idx = b.cycle_idx + 1 AND f.traj_idx = b.child_idx WHERE a.parent_idx >= 0 AND b.parent_idx >= 0")
def sliding_windows_3(t: Tables) -> DataFrame:
    last = t.frames.select("run_idx", "cycle_idx", "traj_idx")
    return lineage.sliding_windows(t.edges.join(last, ["run_idx", "cycle_idx", "traj_idx"]), 3)


@query(", e AS (SELECT run_idx, cycle_idx - 1 AS fc, plain_idx AS fw, cycle_idx AS tc, child_idx AS tw, parent_idx < 0 AS d FROM parents), n AS (SELECT run_idx, tc AS c, tw AS w FROM e UNION SELECT run_idx, fc, fw FROM e) SELECT n.run_idx, n.c AS cycle_idx, count(*) AS n_nodes, (SELECT count(*) FROM e WHERE e.run_idx = n.run_idx AND e.tc = n.c AND e.d) AS n_broken FROM n GROUP BY n.run_idx, n.c")
def parent_forest_levels(t: Tables) -> DataFrame:
    both = t.parents.join(t.plain.withColumnRenamed("parent_idx", "plain_idx"), ["run_idx", "cycle_idx", "child_idx"])
    nodes, edges = lineage.forest(both)
    broken = edges.filter("discontinuity").groupBy("run_idx", F.col("to_cycle").alias("cycle_idx")).agg(F.count("*").alias("n_broken"))
    return nodes.groupBy("run_idx", "cycle_idx").agg(F.count("*").alias("n_nodes")).join(broken, ["run_idx", "cycle_idx"], "left").na.fill({"n_broken": 0})


# contigs

SPANS = """, up AS (SELECT r.run_idx AS span_run, r.run_idx, r.base_run_idx FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.base_run_idx = r.run_idx)
 UNION ALL SELECT u.span_run, r.run_idx, r.base_run_idx FROM up u JOIN runs r ON r.run_idx = u.base_run_idx),
spans AS (SELECT u.span_run, count(*) OVER (PARTITION BY u.span_run ORDER BY u.run_idx) - 1 AS pos, u.run_idx, CAST(coalesce(sum(r.n_cycles) OVER (PARTITION BY u.span_run ORDER BY u.run_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", r.n_cycles FROM up u JOIN runs r ON r.run_idx = u.run_idx)"""


@query(f"{SPANS} SELECT * FROM spans", recursive=True)
def run_spans(t: Tables) -> DataFrame:
    return t.spans


@query(f'{SPANS} SELECT span_run, "offset" + cycle_idx AS contig_cycle, run_idx, cycle_idx FROM (SELECT *, unnest(range(n_cycles)) AS cycle_idx FROM spans)', recursive=True)
def contig_trace(t: Tables) -> DataFrame:
    return contig.contig_trace(t.spans)


@query(f'{SPANS} SELECT s.span_run, w.run_idx, w.cycle_idx, w.walker_idx, w.target_idx, round(w.weight, 6) AS weight, w.cycle_idx + s."offset" AS contig_cycle FROM warping w JOIN spans s ON s.run_idx = w.run_idx', recursive=True)
def contig_records_offset(t: Tables) -> DataFrame:
    return _r(contig.contig_records(t.warping, t.spans), "weight")


@query(f"{SPANS} SELECT DISTINCT f.run_idx, f.traj_idx, f.cycle_idx FROM frames f JOIN spans s ON f.run_idx = s.run_idx AND s.run_idx = s.span_run AND f.cycle_idx = s.n_cycles - 1", recursive=True)
def final_trace(t: Tables) -> DataFrame:
    return contig.final_trace(t.frames, t.spans)


@query(" SELECT DISTINCT run_idx, walker_idx AS traj_idx, cycle_idx FROM warping")
def warp_trace(t: Tables) -> DataFrame:
    return contig.warp_trace(t.warping)


@query(" SELECT DISTINCT run_idx, walker_idx AS traj_idx, cycle_idx FROM res WHERE decision_id = 2")
def resampling_trace_clone(t: Tables) -> DataFrame:
    return contig.resampling_trace(t.resampling, lineage.CLONE)


@query(""", e AS (SELECT p.run_idx, p.cycle_idx + 1 AS c, p.child_idx AS w, p.run_idx AS pr, p.cycle_idx AS pc, p.parent_idx AS pw FROM parents p JOIN runs r ON r.run_idx = p.run_idx WHERE p.parent_idx >= 0 AND p.cycle_idx + 1 < r.n_cycles
 UNION ALL SELECT k.run_idx, 0, p.child_idx, p.run_idx, p.cycle_idx, p.parent_idx FROM parents p JOIN runs r ON r.run_idx = p.run_idx AND p.cycle_idx = r.n_cycles - 1 JOIN conts k ON k.base_run_idx = p.run_idx WHERE p.parent_idx >= 0)
 SELECT f.state AS source, g.state AS target, count(*) AS unweighted_counts, round(sum(f.weight), 6) AS weighted_counts FROM e JOIN frames f ON f.run_idx = e.pr AND f.cycle_idx = e.pc AND f.traj_idx = e.pw JOIN frames g ON g.run_idx = e.run_idx AND g.cycle_idx = e.c AND g.traj_idx = e.w GROUP BY 1, 2""")
def contig_transition_edges(t: Tables) -> DataFrame:
    edges = lineage.frame_edges(t.parents, t.runs, t.continuations)
    return _r(network.transition_edges(t.frames, lineage.sliding_windows(edges, 2), 2), "weighted_counts")


# networks

EDGES = {
    2: " SELECT f.state AS source, g.state AS target, count(*) AS unweighted_counts, round(sum(f.weight), 6) AS weighted_counts FROM parents p JOIN frames f ON f.run_idx = p.run_idx AND f.cycle_idx = p.cycle_idx AND f.traj_idx = p.parent_idx JOIN frames g ON g.run_idx = p.run_idx AND g.cycle_idx = p.cycle_idx + 1 AND g.traj_idx = p.child_idx GROUP BY 1, 2",
    3: " SELECT f.state AS source, g.state AS target, count(*) AS unweighted_counts, round(sum(f.weight), 6) AS weighted_counts FROM parents p JOIN parents q ON p.run_idx = q.run_idx AND q.cycle_idx = p.cycle_idx + 1 AND q.parent_idx = p.child_idx JOIN frames f ON f.run_idx = p.run_idx AND f.cycle_idx = p.cycle_idx AND f.traj_idx = p.parent_idx JOIN frames g ON g.run_idx = q.run_idx AND g.cycle_idx = q.cycle_idx + 1 AND g.traj_idx = q.child_idx GROUP BY 1, 2",
}
NODES = "(SELECT state AS node_id, row_number() OVER (ORDER BY min((run_idx, traj_idx, cycle_idx))) - 1 AS node_idx, count(*) AS num_samples, sum(weight) AS total_weight FROM frames GROUP BY state)"
MATRIX = f", e AS ({EDGES[2]}), n AS {NODES}, m AS (SELECT a.node_idx AS i, b.node_idx AS j, coalesce(CAST(e.unweighted_counts AS DOUBLE), 0.0) AS value FROM n a CROSS JOIN n b LEFT JOIN e ON e.source = a.node_id AND e.target = b.node_id)"


def _edges(t: Tables, length: int) -> DataFrame:
    return network.transition_edges(t.frames, lineage.sliding_windows(t.edges, length), length)


@query(EDGES[2])
def transition_edges_lag2(t: Tables) -> DataFrame:
    return _r(_edges(t, 2), "weighted_counts")


@query(EDGES[3])
def transition_edges_lag3(t: Tables) -> DataFrame:
    return _r(_edges(t, 3), "weighted_counts")


@query(f"{MATRIX} SELECT i, j, value FROM m")
def counts_matrix(t: Tables) -> DataFrame:
    return network.matrix(_edges(t, 2), network.nodes(t.frames), "unweighted_counts")


@query(f"{MATRIX} SELECT i, j, round(CASE WHEN s <> 0 THEN value / s WHEN i = j THEN 1.0 ELSE 0.0 END, 6) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY j) AS s FROM m)")
def prob_matrix_column_norm(t: Tables) -> DataFrame:
    return _r(network.normalized(network.matrix(_edges(t, 2), network.nodes(t.frames), "unweighted_counts")), "value")


@query(f"{MATRIX} SELECT i, j, round(CASE WHEN s <> 0 THEN value / s WHEN i = j THEN 1.0 ELSE 0.0 END, 6) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY i) AS s FROM m)")
def prob_matrix_row_norm(t: Tables) -> DataFrame:
    return _r(network.normalized(network.matrix(_edges(t, 2), network.nodes(t.frames), "unweighted_counts"), "row"), "value")


@query(" SELECT state AS node_id, round(sum(weight), 6) AS total_weight FROM frames GROUP BY state")
def macrostate_weights(t: Tables) -> DataFrame:
    return _r(network.nodes(t.frames).select("node_id", "total_weight"), "total_weight")


@query(f", n AS {NODES} SELECT node_id, node_idx, num_samples, round(total_weight, 6) AS total_weight, node_id IN ('error', 'click') AS group_marked FROM n")
def nodes_table(t: Tables) -> DataFrame:
    return _r(network.with_group(network.nodes(t.frames), "marked", ["error", "click"]), "total_weight")


@query(" SELECT state AS node_id, run_idx, cycle_idx, traj_idx, progress FROM frames WHERE state = 'error'")
def state_fields(t: Tables) -> DataFrame:
    return network.node_frames(t.frames, ["error"], ["progress"])


# rates, summaries, profiles


@query(" SELECT target_idx, round(sum(weight), 6) AS total_weight, round(sum(weight) / 2000.0, 9) AS rate FROM warping GROUP BY target_idx")
def warp_rate_final(t: Tables) -> DataFrame:
    return _r(_r(profiles.warp_rates(t.warping, 2000.0), "total_weight"), "rate", to=9)


@query(""", s AS (SELECT run_idx, max(cycle_idx) + 1 AS n_cycles, count(DISTINCT traj_idx) AS n_walkers FROM frames GROUP BY run_idx),
 g AS (SELECT d.run_idx, d.target_idx, s.n_walkers, unnest(range(s.n_cycles)) AS cycle_idx FROM (SELECT DISTINCT run_idx, target_idx FROM warping) d JOIN s ON s.run_idx = d.run_idx),
 w AS (SELECT run_idx, target_idx, cycle_idx, sum(weight) AS w FROM warping GROUP BY ALL),
 c AS (SELECT g.*, sum(coalesce(w.w, 0)) OVER (PARTITION BY g.run_idx, g.target_idx ORDER BY g.cycle_idx) AS total_weight FROM g LEFT JOIN w ON w.run_idx = g.run_idx AND w.target_idx = g.target_idx AND w.cycle_idx = g.cycle_idx)
 SELECT run_idx, target_idx, cycle_idx, round(total_weight, 6) AS total_weight, round(total_weight / ((cycle_idx + 1) * n_walkers), 6) AS rate FROM c""")
def warp_rate_by_cycle(t: Tables) -> DataFrame:
    return _r(profiles.warp_rates_by_cycle(t.warping, profiles.ensemble_sizes(t.frames)), "total_weight", "rate")


@query(" SELECT run_idx, cycle_idx, round(sum(weight), 6) AS total, round(min(weight), 6) AS least, round(max(weight), 6) AS most, count(*) AS n_walkers FROM frames GROUP BY run_idx, cycle_idx")
def weight_summary_by_cycle(t: Tables) -> DataFrame:
    return _r(profiles.weight_summary(t.frames), "total", "least", "most")


@query(""", a AS (SELECT run_idx, cycle_idx, min(progress) AS least, max(progress) AS most, avg(progress) AS mean, count(*) AS n FROM frames GROUP BY run_idx, cycle_idx),
 b AS (SELECT run_idx, cycle_idx, count(*) AS k, sum(weight) AS w FROM warping GROUP BY run_idx, cycle_idx)
 SELECT a.run_idx, a.cycle_idx, least, most, round(mean, 6) AS mean, CAST(sum(n) OVER o AS BIGINT) AS n_segments, CAST(sum(coalesce(k, 0)) OVER o AS BIGINT) AS n_crossings, round(sum(coalesce(w, 0)) OVER o, 6) AS crossed_weight
 FROM a LEFT JOIN b ON a.run_idx = b.run_idx AND a.cycle_idx = b.cycle_idx WINDOW o AS (PARTITION BY a.run_idx ORDER BY a.cycle_idx)""")
def progress_summary(t: Tables) -> DataFrame:
    return _r(profiles.progress_summary(t.frames, t.warping), "mean", "crossed_weight")


HIST = f"CAST(least(floor((progress - {LOW}) / {(HIGH - LOW) / BINS}), {BINS - 1}) AS BIGINT)"


@query(f", h AS (SELECT {HIST} AS bin, sum(weight) AS total FROM frames WHERE progress BETWEEN {LOW} AND {HIGH} GROUP BY 1) SELECT bin, round(total, 6) AS total, round(-ln(total / sum(total) OVER ()) - min(-ln(total)) OVER () - ln(sum(total) OVER ()), 6) AS free_energy FROM h")
def fe_profile_hist(t: Tables) -> DataFrame:
    h = profiles.free_energy(profiles.weighted_histogram(t.frames, "progress", LOW, HIGH, BINS))
    return _r(h, "total", "free_energy")


@query(f", p AS (SELECT unnest(range(5)) AS part, unnest({PARTS}) AS e), h AS (SELECT part, {HIST} AS bin, sum(weight) AS total FROM frames JOIN p ON cycle_idx < e WHERE progress BETWEEN {LOW} AND {HIGH} GROUP BY 1, 2) SELECT part, bin, round(total, 6) AS total, round(max(ln(total)) OVER (PARTITION BY part) - ln(total), 6) AS free_energy FROM h")
def fe_cumulative_prefix(t: Tables) -> DataFrame:
    h = profiles.cumulative_histograms(t.frames, "progress", LOW, HIGH, BINS, profiles.prefix_ends(100, 5))
    return _r(profiles.free_energy(h, ["part"]), "total", "free_energy")


@query(" SELECT run_idx, cycle_idx, 100.0 * count(*) FILTER (d = 2) / count(*) AS cloned, 100.0 * count(*) FILTER (d IN (3, 4)) / count(*) AS merged FROM (SELECT run_idx, cycle_idx, walker_idx, max(decision_id) AS d FROM res GROUP BY ALL) GROUP BY run_idx, cycle_idx")
def clone_merge_percentages(t: Tables) -> DataFrame:
    return profiles.decision_percentages(t.resampling)


# resampling


@query(""", n AS (SELECT run_idx, cycle_idx, walker_idx, count(*) AS k FROM res GROUP BY ALL)
 SELECT r.run_idx, r.cycle_idx, r.target_idx AS slot, max(CASE WHEN r.decision_id <> 3 THEN r.walker_idx END) AS source_idx, round(sum(f.weight / n.k), 6) AS weight FROM res r JOIN n ON n.run_idx = r.run_idx AND n.cycle_idx = r.cycle_idx AND n.walker_idx = r.walker_idx JOIN frames f ON f.run_idx = r.run_idx AND f.cycle_idx = r.cycle_idx AND f.traj_idx = r.walker_idx GROUP BY 1, 2, 3""")
def apply_decisions(t: Tables) -> DataFrame:
    return _r(resampling.apply_decisions(t.frames, t.resampling), "weight")


@query(" SELECT run_idx, cycle_idx, traj_idx FROM (SELECT *, sum(weight) OVER (PARTITION BY run_idx, cycle_idx) AS s FROM (SELECT run_idx, cycle_idx, traj_idx, weight, row_number() OVER (PARTITION BY run_idx, cycle_idx ORDER BY weight, traj_idx) AS k FROM frames) WHERE k <= 3) WHERE s <= 0.02")
def k_lightest_merge(t: Tables) -> DataFrame:
    return resampling.lightest_to_merge(t.frames, 2, 0.02)


@query(" SELECT run_idx, cycle_idx, count(*) FILTER (s <= 0.1) - 1 AS n FROM (SELECT run_idx, cycle_idx, sum(weight) OVER (PARTITION BY run_idx, cycle_idx ORDER BY weight, traj_idx ROWS UNBOUNDED PRECEDING) AS s FROM frames) GROUP BY run_idx, cycle_idx")
def squashable_walkers(t: Tables) -> DataFrame:
    return resampling.squashable(t.frames, 0.1)


IMAGES = """WITH im AS (SELECT CAST(floor(vec_id / 20.0) AS BIGINT) AS run_idx, CAST(0 AS BIGINT) AS cycle_idx, vec_id % 20 AS traj_idx, CAST(embedding AS DOUBLE[]) AS image, label, (vec_id % 7 + 1) / 400.0 AS weight FROM embeddings),
pairs AS (SELECT a.run_idx, a.cycle_idx, a.traj_idx AS i, b.traj_idx AS j, list_distance(a.image, b.image) AS distance, a.weight AS wi, b.weight AS wj FROM im a JOIN im b ON a.run_idx = b.run_idx AND a.traj_idx < b.traj_idx)"""


def _pairs(t: Tables) -> DataFrame:
    return resampling.distance_pairs(t.images, geometry.euclidean)


@query()
def distance_pairs(t: Tables) -> DataFrame:
    return _r(_pairs(t), "distance", to=4)


ORACLES["distance_pairs"] = f"{IMAGES} SELECT run_idx, cycle_idx, i, j, round(distance, 4) AS distance FROM pairs"


@query()
def revo_variation(t: Tables) -> DataFrame:
    return _r(resampling.variation(_pairs(t), t.images, 10.0), "variation", to=3)


ORACLES["revo_variation"] = f"{IMAGES} SELECT run_idx, cycle_idx, round(sum(pow(distance / 10.0, 4) * greatest(0, ln(wi) - ln(1e-14)) * greatest(0, ln(wj) - ln(1e-14))), 3) AS variation FROM pairs GROUP BY 1, 2"


@query()
def revo_eligible_pairs(t: Tables) -> DataFrame:
    return _r(resampling.merge_candidates(_pairs(t), t.images, 9.0, 0.03), "distance", to=4)


ORACLES["revo_eligible_pairs"] = f"{IMAGES} SELECT run_idx, cycle_idx, i, j, round(distance, 4) AS distance FROM pairs WHERE distance < 9.0 AND wi + wj < 0.03"


@query()
def nearest_region(t: Tables) -> DataFrame:
    centres = t.images.filter("traj_idx % 5 = 0").select("run_idx", (F.col("traj_idx") / 5).cast("long").alias("region_idx"), "image")
    return _r(resampling.nearest(t.images, centres, geometry.euclidean), "distance", to=4)


ORACLES["nearest_region"] = f"{IMAGES}, d AS (SELECT a.run_idx, a.cycle_idx, a.traj_idx, b.traj_idx // 5 AS region_idx, list_distance(a.image, b.image) AS distance FROM im a JOIN im b ON a.run_idx = b.run_idx AND b.traj_idx % 5 = 0) SELECT run_idx, cycle_idx, traj_idx, arg_min(region_idx, (distance, region_idx)) AS region_idx, round(min(distance), 4) AS distance FROM d GROUP BY 1, 2, 3"


@query()
def region_rollup(t: Tables) -> DataFrame:
    rows = t.images.select(F.array("label", F.col("traj_idx") % 4, F.col("traj_idx") % 2).alias("region"), "weight")
    out = resampling.region_rollup(rows)
    return _r(out.select(F.array_join("region", "/").alias("region"), "n_walkers", "weight"), "weight")


ORACLES["region_rollup"] = """WITH r AS (SELECT label AS a, vec_id % 20 % 4 AS b, vec_id % 20 % 2 AS c, (vec_id % 7 + 1) / 400.0 AS w FROM embeddings)
SELECT region, count(*) AS n_walkers, round(sum(w), 6) AS weight FROM (SELECT CAST(a AS VARCHAR) AS region, w FROM r UNION ALL SELECT a || '/' || b, w FROM r UNION ALL SELECT a || '/' || b || '/' || c, w FROM r) GROUP BY region"""


@query()
def revo_decide(t: Tables) -> DataFrame:
    return _r(resampling.greedy_decisions(t.images, 10.0, 1.0), "variation", to=3)


@query()
def wexplore_balance(t: Tables) -> DataFrame:
    return resampling.balanced_shares(t.images.select("run_idx", "cycle_idx", F.col("label").alias("region_idx")))


@query(" SELECT run_idx, cycle_idx, traj_idx AS walker_idx, CAST(0 AS BIGINT) AS target_idx, round(weight, 6) AS weight FROM frames WHERE progress >= 80.0")
def warp_walkers(t: Tables) -> DataFrame:
    _, records = resampling.warp_walkers(t.frames, F.col("progress") >= 80.0, [1.0])
    return _r(records, "weight")


# observables, functions, catalog, store


@query(" SELECT run_idx, traj_idx, cycle_idx, round(progress / 100.0 + cycle_idx, 6) AS scaled FROM frames")
def observable_udf(t: Tables) -> DataFrame:
    return _r(observables.compute_observable(t.frames.withColumn("c", F.col("cycle_idx")), lambda x: x.progress / 100.0 + x.c, ["progress", "c"], "scaled"), "scaled")


@query(" SELECT run_idx, traj_idx, cycle_idx, round(sum(progress) OVER (PARTITION BY run_idx, traj_idx ORDER BY cycle_idx), 4) AS running FROM frames")
def observable_per_trajectory(t: Tables) -> DataFrame:
    return _r(observables.compute_observable(t.frames, lambda x: x.progress.cumsum(), ["progress"], "running"), "running", to=4)


def _topology(t: Tables) -> DataFrame:
    atom = lambda i, e: f'{{"index": {i}, "name": "A{i}", "element": "{e}"}}'
    chain = '{"chains": [{"index": 0, "residues": [{"index": 0, "name": "R", "resSeq": 1, "segmentID": "s", "atoms": [%s]}, {"index": 1, "name": "Q", "resSeq": 2, "segmentID": "s", "atoms": [%s]}]}], "bonds": [[0, 1], [1, 2]]}'
    return t.spark.range(1).select(F.lit(chain % (f"{atom(0, 'C')}, {atom(1, 'N')}", atom(2, "O"))).alias("topology"))


@query()
def topology_atoms(t: Tables) -> DataFrame:
    return topology.atoms(_topology(t))


ORACLES["topology_atoms"] = "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 0::BIGINT, 'A0', 'C'), (0, 0, 1, 'A1', 'N'), (0, 1, 2, 'A2', 'O')) v(chain_idx, residue_idx, atom_idx, atom_name, element)"


@query()
def box_lengths_angles(t: Tables) -> DataFrame:
    r = t.spark.read.parquet(f"{t.dir}/region.parquet").select("r_regionkey")
    k = F.col("r_regionkey").cast("double")
    box = geometry.box_vectors(k + 1.0, k + 2.0, k + 3.0, F.lit(60.0), F.lit(70.0), F.lit(80.0))
    return _r(r.select("r_regionkey", geometry.box_lengths_angles(box).alias("b")).select("r_regionkey", "b.*"), "a", "b", "c", "ab", "bc", "ca")


ORACLES["box_lengths_angles"] = "SELECT r_regionkey, r_regionkey + 1.0::DOUBLE AS a, r_regionkey + 2.0::DOUBLE AS b, r_regionkey + 3.0::DOUBLE AS c, 80.0::DOUBLE AS ab, 60.0::DOUBLE AS bc, 70.0::DOUBLE AS ca FROM region"


def _catalog(t: Tables) -> DataFrame:
    h = lambda c: F.md5(c.cast("string"))
    base = F.coalesce("base_run_idx", F.lit(-1) - F.col("run_idx"))
    return t.runs.select(h(base).alias("start_hash"), h(F.col("run_idx")).alias("end_hash"), h(F.col("run_idx") % 2).alias("config_hash"), (F.col("n_cycles") - 1).alias("last_cycle_idx"))


CATALOG = ", cat AS (SELECT md5(CAST(coalesce(base_run_idx, -1 - run_idx) AS VARCHAR)) AS start_hash, md5(CAST(run_idx AS VARCHAR)) AS end_hash, md5(CAST(run_idx % 2 AS VARCHAR)) AS config_hash, n_cycles - 1 AS last_cycle_idx FROM runs)"


@query(f"{CATALOG} SELECT a.start_hash, a.end_hash, b.start_hash AS base_start, b.end_hash AS base_end FROM cat a JOIN cat b ON a.start_hash = b.end_hash")
def run_continues(t: Tables) -> DataFrame:
    return catalog.run_continues(_catalog(t))


@query(f"{CATALOG}, host AS (SELECT * FROM cat WHERE last_cycle_idx % 2 = 1 AND substr(end_hash, 1, 1) < '9') SELECT * FROM host UNION ALL (SELECT * FROM cat EXCEPT SELECT * FROM host)")
def reconcile_except(t: Tables) -> DataFrame:
    c = _catalog(t)
    return catalog.reconcile(c.filter("last_cycle_idx % 2 = 1 AND substr(end_hash, 1, 1) < '9'"), c)


@query(" SELECT CAST(99 AS BIGINT) AS run_idx, cycle_idx - 10 AS cycle_idx, traj_idx, state, progress FROM frames WHERE run_idx = 0 AND cycle_idx >= 10 AND cycle_idx < 30")
def run_slice(t: Tables) -> DataFrame:
    return contig.slice_run(t.frames.select("run_idx", "cycle_idx", "traj_idx", "state", "progress"), 0, 10, 30, 99)


@query(" SELECT run_idx, cycle_idx, traj_idx, progress FROM frames UNION ALL SELECT run_idx + 1000, cycle_idx, traj_idx, progress FROM frames")
def union_runs_offset(t: Tables) -> DataFrame:
    f = t.frames.select("run_idx", "cycle_idx", "traj_idx", "progress")
    return contig.append_runs(f, f, 1000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from . import stores, trees  # noqa: E402, F401  they register their queries
