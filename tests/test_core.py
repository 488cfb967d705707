"""Hand-made fixtures for lineage, contigs, stores, catalogs and greedy decisions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlake.functions import geometry, topology
from braidlake.operators import contig, layout, lineage, network, observables, profiles, regions, resampling
from braidlake.sources import catalog
from braidlake.sources.store import Store
from braidlake.streaming import dashboard


@pytest.fixture(scope="module")
def micro(spark):
    """Three walkers, three cycles: in cycle 0 walker 0 clones into slot 2, 2 is squashed into 1; in cycle 1 walker 0 warps."""
    records = [(0, 0, 0, 0, 2, [0, 2]), (0, 0, 0, 1, 4, [1]), (0, 0, 0, 2, 3, [1])]
    records += [(0, c, 0, w, 1, [w]) for c in (1, 2) for w in range(3)]
    res = spark.createDataFrame(records, "run_idx long, cycle_idx long, step_idx long, walker_idx long, decision_id long, target_idxs array<long>")
    warps = spark.createDataFrame([(0, 1, 0, 0, 0.2)], "run_idx long, cycle_idx long, walker_idx long, target_idx long, weight double")
    return res, warps


def parent_rows(df):
    return sorted(tuple(r) for r in df.select("cycle_idx", "child_idx", "parent_idx").collect())


def test_parents(micro):
    res, warps = micro
    plain = lineage.net_parents(res)
    assert parent_rows(plain)[:6] == [(0, 0, 0), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 1), (1, 2, 2)]
    assert parent_rows(lineage.broken(plain, warps, (0,)))[3] == (1, 0, -1)
    assert parent_rows(lineage.broken(plain, warps, (1,))) == parent_rows(plain)
    assert parent_rows(lineage.broken(plain, warps, "all"))[3] == (1, 0, -1) and parent_rows(lineage.broken(plain, warps, None)) == parent_rows(plain)


def test_two_steps_compose(spark):
    rows = [(0, 0, 0, 0, 1, [1]), (0, 0, 0, 1, 1, [0]), (0, 0, 1, 0, 2, [0, 1]), (0, 0, 1, 1, 3, [0])]
    res = spark.createDataFrame(rows, "run_idx long, cycle_idx long, step_idx long, walker_idx long, decision_id long, target_idxs array<long>")
    assert parent_rows(lineage.net_parents(res, steps=2)) == [(0, 0, 1), (0, 1, 1)]


def test_lineages_and_windows(spark, micro):
    res, warps = micro
    plain = lineage.net_parents(res)
    cut = lineage.broken(plain, warps, (0,))
    trace = spark.createDataFrame([(0, 2, w) for w in range(3)], "run_idx long, cycle_idx long, traj_idx long")

    def lines(p):
        out = {}
        for r in sorted(lineage.ancestors(p, trace).collect(), key=lambda r: r.cycle_idx):
            out.setdefault(r.end_traj, []).append((r.traj_idx, r.cycle_idx))
        return out

    assert lines(cut) == {0: [(0, 2)], 1: [(1, 0), (1, 1), (1, 2)], 2: [(0, 0), (2, 1), (2, 2)]}
    assert lines(plain)[0] == [(0, 0), (0, 1), (0, 2)]
    edges = lineage.frame_edges(cut).filter("cycle_idx <= 2")
    three = {tuple(r) for r in lineage.sliding_windows(edges, 3).select("traj_0", "traj_1", "traj_2").collect()}
    assert three == {(1, 1, 1), (0, 2, 2)}
    two = {tuple(r) for r in lineage.sliding_windows(edges, 2).select("cycle_1", "traj_1").collect()}
    assert two == {(1, 0), (1, 1), (1, 2), (2, 1), (2, 2)}
    with pytest.raises(ValueError):
        lineage.sliding_windows(edges, 1)
    roots = {r.end_traj: (r.root_cycle, r.root_traj) for r in lineage.roots_of(cut, trace).collect()}
    assert roots == {0: (2, 0), 1: (0, 1), 2: (0, 0)}


def test_spans_and_offsets(spark):
    runs = spark.createDataFrame([(0, 3, None), (1, 2, 0), (2, 4, 0), (3, 1, 1)], "run_idx long, n_cycles long, base_run_idx long")
    spans = contig.spans(runs)
    assert sorted(tuple(r)[:4] for r in spans.collect()) == [(2, 0, 0, 0), (2, 1, 2, 3), (3, 0, 0, 0), (3, 1, 1, 3), (3, 2, 3, 5)]
    assert contig.contig_trace(spans).count() == 7 + 6
    conts = runs.filter("base_run_idx is not null").select("run_idx", "base_run_idx")
    assert contig.is_contig(conts, [0, 1, 3]) and not contig.is_contig(conts, [0, 3]) and contig.is_contig(conts, [2])
    loop = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 1)], "run_idx long, n_cycles long, base_run_idx long")
    with pytest.raises(ValueError):
        contig.spans(loop)


def test_trace_keeps_order_and_repeats(spark):
    frames = spark.createDataFrame([(0, 0, c, float(c)) for c in range(3)], "run_idx long, traj_idx long, cycle_idx long, x double")
    trace = spark.createDataFrame([(0, 0, 0, 2), (1, 0, 0, 0), (2, 0, 0, 2), (3, 0, 0, 9)], "pos long, run_idx long, traj_idx long, cycle_idx long")
    assert [r.x for r in contig.trace_fields(frames, trace, ["x"]).orderBy("pos").collect()] == [2.0, 0.0, 2.0, None]


def test_matrix_and_normalisation(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "b", 1)], "source string, target string, n long")
    nodes = spark.createDataFrame([("a", 0), ("b", 1)], "node_id string, node_idx long")
    cells = network.matrix(edges, nodes, "n")
    got = {(r.i, r.j): r.value for r in network.normalized(cells).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.75, (1, 0): 0.0, (1, 1): 0.25}
    rows = {(r.i, r.j): r.value for r in network.normalized(cells, "row").collect()}
    assert rows == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 0.0, (1, 1): 1.0}


def test_gexf(spark, tmp_path):
    nodes = spark.createDataFrame([("a<", 0, 0.5)], "node_id string, node_idx long, total_weight double")
    edges = spark.createDataFrame([("a<", "a<", 2)], "source string, target string, n long")
    network.write_gexf(nodes, edges, str(tmp_path / "n.gexf"))
    from xml.etree import ElementTree

    (part,) = (tmp_path / "n.gexf").glob("part-*")
    root = ElementTree.parse(part).getroot()
    assert len(root.findall(".//{*}node")) == 1 and root.find(".//{*}edge").get("source") == "a<"


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(x, 1.0) for x in (0.0, 0.99, 1.0, 2.0, 2.01, -0.1)], "x double, weight double")
    assert {r.bin: r.total for r in profiles.weighted_histogram(df, "x", 0.0, 2.0, 2).collect()} == {0: 2.0, 1: 2.0}
    h = profiles.free_energy(profiles.weighted_histogram(df.filter("x < 1.5 and x >= 0"), "x", 0.0, 2.0, 2))
    assert {r.bin: round(r.free_energy, 9) for r in h.collect()} == {0: 0.0, 1: round(math.log(2), 9)}
    assert profiles.bin_edges(df, "x", 3)[0] == -0.1 and len(profiles.bin_edges(df, "x")) >= 4
    assert profiles.prefix_ends(11, 5) == [3, 4, 6, 8, 10]


def test_decisions_conserve_weight(spark):
    rng = np.random.default_rng(3)
    rows = [(r, c, w, 1 / 20, [float(v) for v in rng.normal(size=3) * (1 + w % 3)]) for r in range(2) for c in range(3) for w in range(20)]
    walkers = spark.createDataFrame(rows, "run_idx long, cycle_idx long, traj_idx long, weight double, image array<double>")
    decided = resampling.greedy_decisions(walkers, 5.0, 1.0, pmax=0.2)
    assert {r.decision_id for r in decided.collect()} >= {1, 2, 3, 4}
    after = resampling.apply_decisions(walkers, decided)
    assert resampling.misplaced(walkers, decided).isEmpty()
    for r in after.groupBy("run_idx", "cycle_idx").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.count("source_idx").alias("s")).collect():
        assert abs(r.w - 1) < 1e-9 and r.n == r.s == 20
    assert resampling.out_of_bounds(after, 1e-12, 0.2).isEmpty()
    assert sorted(map(tuple, decided.select("run_idx", "cycle_idx", "walker_idx", "decision_id").collect())) == sorted(map(tuple, resampling.greedy_decisions(walkers, 5.0, 1.0, pmax=0.2).select("run_idx", "cycle_idx", "walker_idx", "decision_id").collect()))


def test_balance_keeps_the_number_of_walkers(spark):
    rows = [(0, 0, r) for r, n in ((0, 12), (1, 1), (2, 7)) for _ in range(n)]
    got = resampling.balanced_shares(spark.createDataFrame(rows, "run_idx long, cycle_idx long, region_idx long")).collect()
    assert sum(r.shares for r in got) == 20 and max(r.shares for r in got) - min(r.shares for r in got) <= 1


def test_warping(spark):
    rows = [(0, 0, w, 0.05, float(w)) for w in range(20)]
    walkers = spark.createDataFrame(rows, "run_idx long, cycle_idx long, traj_idx long, weight double, progress double")
    out, records = resampling.warp_walkers(walkers, F.col("progress") >= 10, [1.0, 1.0], seed=4)
    assert records.count() == 10 and out.filter("target_idx is null").count() == 10
    assert {r.target_idx for r in records.collect()} == {0, 1}
    assert records.agg(F.sum("weight")).first()[0] == pytest.approx(0.5)


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(geometry.euclidean(F.col("a"), F.col("b")).alias("e"), geometry.mean_absolute(F.col("a"), F.col("b")).alias("m"), geometry.wrapped(F.lit(9.0), 10.0).alias("w")).first()
    assert (r.e, r.m, r.w) == (5.0, 3.5, -1.0)
    box = geometry.box_vectors(F.lit(2.0), F.lit(3.0), F.lit(4.0), F.lit(90.0), F.lit(90.0), F.lit(90.0))
    assert [[round(x, 9) for x in v] for v in spark.range(1).select(box.alias("b")).first().b] == [[2, 0, 0], [0, 3, 0], [0, 0, 4]]


def test_topology_subset(spark):
    text = '{"chains": [{"index": 0, "residues": [{"index": 0, "name": "R", "resSeq": 1, "segmentID": "", "atoms": [{"index": 0, "name": "a", "element": "C"}, {"index": 1, "name": "b", "element": "N"}, {"index": 2, "name": "c", "element": "O"}]}]}], "bonds": [[0, 1], [1, 2]]}'
    df = spark.createDataFrame([(text,)], "topology string")
    assert df.select(topology.atom_count(F.col("topology"))).first()[0] == 3
    assert topology.chains(df).first().n_residues == 1
    rows, bonds = topology.subset(df, [2, 1])
    assert sorted((r.new_idx, r.atom_name) for r in rows.collect()) == [(0, "c"), (1, "b")] and [tuple(b) for b in bonds.collect()] == [(1, 0)]
    with pytest.raises(ValueError):
        topology.subset(df, [1, 1])


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    frames = spark.createDataFrame([(r, w, c, c / 10) for r in range(2) for w in range(2) for c in range(5)], "run_idx long, traj_idx long, cycle_idx long, x double")
    with Store(spark, path, "x") as s:
        s.append("frames", frames)
        s.new_run(0)
        s.new_run(1, continues=0, note="n")
        s.add_metadata("k", "v")
        s.register("x", dtype="double")
    with pytest.raises(FileExistsError):
        Store(spark, path, "x")
    with pytest.raises(FileNotFoundError):
        Store(spark, path + "-", "r")
    s = Store(spark, path, "a")
    with pytest.raises(ValueError):
        s.append("frames", frames.withColumn("y", F.lit(1)))
    with pytest.raises(ValueError):
        s.new_run(1)
    with pytest.raises(ValueError):
        s.new_run(5, continues=9)
    with pytest.raises(AttributeError):
        s.register("x", dtype="float")
    with pytest.raises(PermissionError):
        Store(spark, path).append("frames", frames)
    s.append("frames", frames.limit(1).withColumns({"cycle_idx": F.lit(7).cast("long"), "observables_o": F.lit(1.5)}))
    assert s.metadata() == {"k": "v"} and [tuple(r) for r in s.table("continuations").collect()] == [(1, 0)]
    assert [r.cycle_idx for r in s.field_cycles(0, 0, "observables_o").collect()] == [7]
    other = Store(spark, str(tmp_path / "other"), "w")
    s.copy_slice(other, 1, 1, 4, 8)
    assert sorted({(r.run_idx, r.cycle_idx) for r in other.frames().collect()}) == [(8, 0), (8, 1), (8, 2)]
    assert {r.run_idx for r in s.union(other, "frames", 100).select("run_idx").distinct().collect()} == {0, 1, 108}


def test_catalog(spark):
    runs = spark.createDataFrame([("a", "b", "c", 1), ("b", "d", "c", 2)], "start_hash string, end_hash string, config_hash string, last_cycle_idx long")
    assert [tuple(r) for r in catalog.run_continues(runs).collect()] == [("b", "d", "a", "b")]
    snaps = spark.createDataFrame([(x,) for x in "abde"], "hash string")
    confs = spark.createDataFrame([("c",)], "hash string")
    new = spark.createDataFrame([("d", "e", "c", 3)], runs.schema)
    assert catalog.register_runs(runs, new, snaps, confs).count() == 3
    with pytest.raises(ValueError):
        catalog.register_runs(runs, runs.limit(1), snaps, confs)
    with pytest.raises(ValueError):
        catalog.register_runs(runs, new.withColumn("end_hash", F.lit("z")), snaps, confs)
    assert catalog.reconcile(runs, runs.unionByName(new)).count() == 3
    kv = spark.createDataFrame([("k", "1"), (None, "2")], "key string, value string")
    got = {r.key: r.value for r in catalog.upsert(kv, spark.createDataFrame([(None, "3")], kv.schema)).collect()}
    assert got == {"k": "1", None: "3"}


def test_observables(spark):
    rows = [(0, w, c, float(c * w)) for w in range(2) for c in range(4)]
    random.Random(1).shuffle(rows)
    frames = spark.createDataFrame(rows, "run_idx long, traj_idx long, cycle_idx long, x double")
    got = observables.attach(frames, observables.compute_observable(frames, lambda p: p.x.cumsum(), ["x"], "sum"), "sum")
    assert {(r.traj_idx, r.cycle_idx): r.observables_sum for r in got.collect()}[1, 3] == 6.0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, w, c, 0.5, float(c + w)) for c in range(6) for w in range(2)]
    schema = "run_idx long, traj_idx long, cycle_idx long, weight double, progress double"
    df = spark.createDataFrame(rows, schema)
    for c in range(6):
        df.filter(F.col("cycle_idx") == c).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = dashboard.frame_stream(spark, str(tmp_path / "in"), schema, files_per_batch=2)
    dashboard.run_dashboard(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, dashboard.cycle_summary(df).collect()))


def test_lineages_across_blocks(spark):
    """Walks in blocks, chained by doubling, against a walk over everything; two runs continue run 0."""
    rng = np.random.default_rng(4)
    n = {0: 23, 1: 40, 2: 9}
    rows = [(r, c, w, int(rng.integers(-1, 4)) if rng.random() < 0.2 else w) for r in n for c in range(n[r]) for w in range(4)]
    parents = spark.createDataFrame(rows, "run_idx long, cycle_idx long, child_idx long, parent_idx long")
    runs = spark.createDataFrame([(0, 23, None), (1, 40, 0), (2, 9, 0)], "run_idx long, n_cycles long, base_run_idx long")
    conts = runs.filter("base_run_idx is not null").select("run_idx", "base_run_idx")
    up = {(r, c + 1, w): (r, c, p) for r, c, w, p in rows if p >= 0}
    ends = [(r, n[r] - 1, w) for r in n for w in range(4)]
    trace = spark.createDataFrame(ends, "run_idx long, cycle_idx long, traj_idx long")

    def walk(at, edges):
        out = [at]
        while at in edges:
            at = edges[at]
            out.append(at)
        return out

    inside = {e: walk(e, up) for e in ends}
    assert sorted(tuple(r) for r in lineage.ancestors(parents, trace, block=5).collect()) == sorted((e[0], e[1], e[2], a[1], a[2]) for e in ends for a in inside[e])
    assert sorted(tuple(r) for r in lineage.roots_of(parents, trace, block=5).collect()) == sorted((*e, *inside[e][-1][1:]) for e in ends)
    across = {k: v for k, v in up.items() if k[1] < n[k[0]]} | {(r, 0, w): (0, 22, p) for r in (1, 2) for q, c, w, p in rows if q == 0 and c == 22 and p >= 0}
    edges = lineage.frame_edges(parents, runs, conts)
    want = sorted((*e, *a) for e in ends for a in walk(e, across))
    for block in (4, 4096):
        assert sorted(tuple(r) for r in lineage.tree_lineages(edges, trace, block).collect()) == want


def test_long_chains_of_runs(spark):
    runs = spark.createDataFrame([(i, 2, i - 1 if i else None) for i in range(37)], "run_idx long, n_cycles long, base_run_idx long")
    rows = contig.spans(runs).collect()
    assert sorted((r.pos, r.run_idx, r.offset) for r in rows) == [(i, i, 2 * i) for i in range(37)]
    assert contig.to_runs([(2, 1), (1, 0), (3, 2)]) == [0, 1, 2, 3] and contig.to_continuations([0, 1, 2]) == [(1, 0), (2, 1)]
    for wrong in ([(1, 0), (2, 0)], [(1, 0), (0, 1)]):
        with pytest.raises(ValueError):
            contig.to_runs(wrong)


def test_shares_without_a_limit(spark):
    rows = [(0, 0, 0)] * 400 + [(0, 0, k) for k in range(1, 201)]
    got = resampling.balanced_shares(spark.createDataFrame(rows, "run_idx long, cycle_idx long, region_idx long")).collect()
    assert sum(r.shares for r in got) == 600 and max(r.shares for r in got) - min(r.shares for r in got) <= 1


def test_greedy_decisions_against_a_slow_version():
    """The published loop, written down plainly, with the same draws."""
    for seed in range(25):
        rng = np.random.default_rng(seed)
        n = 9
        w, x = rng.random(n) ** 3 + 1e-3, rng.random((n, 3))
        w /= w.sum()
        d = np.abs(x[:, None] - x[None]).mean(2)
        draws = rng.random(200)
        for method in ("pairs", "greedy"):
            it = iter(draws)
            got = resampling.decide_greedily(w, d, 0.5, 0.1, 1e-6, 0.4, 4.0, method, lambda i=it: next(i))
            assert got[:2] == _slow(w, d, 0.5, 0.1, 1e-6, 0.4, 4.0, method, iter(draws))


def _slow(w, d, merge, char, pmin, pmax, power, method, draws):
    n, w, copies = len(w), list(w), [1.0] * len(w)
    groups, clones = [[] for _ in w], [0] * n

    def novelty(i):
        return max(0.0, np.log(w[i] / copies[i]) - np.log(pmin / 100)) if w[i] > 0 and copies[i] > 0 else 0.0

    def measure():
        part = [sum((d[i][j] / char) ** power * novelty(i) * novelty(j) * copies[i] * copies[j] for j in range(n) if j != i) for i in range(n)]
        return sum(part) / 2, part

    value, part = measure()
    while True:
        can = [(part[i], i) for i in range(n) if copies[i] >= 1 and w[i] / (copies[i] + 1) > pmin and not groups[i]]
        if not can:
            return groups, clones
        top = max(can)[1]
        pair = None
        if method == "pairs":
            options = [((w[j] * part[i] + w[i] * part[j]) / (w[i] + w[j]), i, j) for i in range(n) for j in range(i + 1, n) if top not in (i, j) and copies[i] == copies[j] == 1 and w[i] + w[j] < pmax and d[i][j] < merge]
            if options:
                pair = min(options)[1:]
        else:
            low = [(part[i], i) for i in range(n) if copies[i] == 1 and w[i] < pmax]
            if low and (a := min(low)[1]) != top:
                near = [(d[a][k], k) for k in range(n) if k not in (a, top) and copies[k] == 1 and w[k] + w[a] < pmax and d[a][k] < merge]
                pair = (a, min(near)[1]) if near else None
        if pair is None:
            return groups, clones
        a, b = pair
        before = list(copies)
        copies[a], copies[b], copies[top] = w[a] / (w[a] + w[b]), w[b] / (w[a] + w[b]), copies[top] + 1
        new, _ = measure()
        if new <= value:
            copies[:] = before
            return groups, clones
        value = new
        keep, lose = (b, a) if next(draws) * (w[a] + w[b]) < w[b] else (a, b)
        w[keep], w[lose], copies[keep], copies[lose] = w[a] + w[b], 0.0, 1, 0
        groups[keep] += [lose, *groups[lose]]
        groups[lose] = []
        clones[top] += 1
        part = measure()[1]


def test_region_trees():
    tree = regions.RegionTree((1.0, 0.4), (3, 2), lambda a, b: float(abs(a - b).max()))
    tree.plant(np.array([0.0]))
    assert tree.place(np.array([0.1])) == ((0, 0), [0.1, 0.1], None)
    assert tree.place(np.array([0.6]))[::2] == ((0, 1), 1)
    assert tree.place(np.array([5.0]))[::2] == ((1, 0), 0)
    assert tree.leaves() == [(0, 0), (0, 1), (1, 0)] and tree.nodes(1) == [(0,), (1,)]
    assert regions.pay(-3, [2, 5], [0, 0]) == [-2, -1] and regions.pay(4, [0, 0], [1, 9]) == [1, 3] and regions.pay(7, [0], [0]) == [7]
    with pytest.raises(ValueError):
        regions.pay(-9, [2, 5], [0, 0])
    assert regions.even_out([9, 1], [8, 0], [9, 9]) == [5, 5] and regions.even_out([9, 1], [2, 0], [9, 9]) == [7, 3]
    weights = np.array([0.4, 0.05, 0.05, 0.3, 0.2])
    members = {(0, 0): [0, 1, 2, 3], (0, 1): [4], (1, 0): []}
    balances = regions.leaf_balances(tree, members, weights, 0.01, 0.5, 5)
    assert sum(balances.values()) == 0 and balances[0, 0] < 0 < balances[0, 1]
    groups, clones = regions.settle(balances, members, weights, 0.01, 0.5, 5, lambda few, _: few[0])
    assert sum(map(len, groups)) == sum(clones) == balances[0, 1]


def test_walker_limits_and_records():
    assert resampling.walker_limits(5) == (5, 5) and resampling.walker_limits(5, None, 8) == (None, 8)
    for args in ((0,), (5, 6), (5, None, 4)):
        with pytest.raises(ValueError):
            resampling.walker_limits(*args)
    assert resampling.record("CLONE", [1, 2]) == (2, [1, 2]) and resampling.decision_name(3) == "SQUASH"
    with pytest.raises(ValueError):
        resampling.decision_records([[1], []], [1, 0])


def test_store_commits(spark, tmp_path):
    path = str(tmp_path / "s")
    frames = spark.createDataFrame([(0, 0, c, [1.0, 2.0]) for c in range(4)], "run_idx long, traj_idx long, cycle_idx long, x array<double>")
    s = Store(spark, path, "x", shapes={"x": [2]}, sparse=("y",))
    s.new_run(0)
    with pytest.raises(RuntimeError), s.transaction():
        s.append("frames", frames)
        raise RuntimeError
    assert not s.has("frames") and s.vacuum() == []
    other = Store(spark, path, "a")
    s.append("frames", frames)
    other.append("frames", frames.withColumn("traj_idx", F.lit(1).cast("long")))  # on top of what it had not read
    assert other.table("frames").count() == 8 and s.table("frames").count() == 4
    assert Store(spark, path, "r", version=s.version - 1).version == s.version - 1
    s.refresh()
    assert s.table("frames").count() == 8
    rows = frames.select("cycle_idx", "x")
    with pytest.raises(ValueError):
        s.add_traj(3, rows)
    with pytest.raises(ValueError):
        s.add_traj(0, rows.withColumn("x", F.array(F.lit(1.0))))
    with pytest.raises(ValueError):
        s.extend_traj(0, 0, rows)
    with pytest.raises(ValueError):
        s.extend_traj(0, 0, rows.withColumns({"cycle_idx": F.col("cycle_idx") + 4, "z": F.lit(1)}))
    s.extend_traj(0, 0, rows.withColumn("cycle_idx", F.col("cycle_idx") + 4).withColumn("y", F.lit(1)))
    assert s.field(0, 0, "x").count() == 8 and s.inconsistent(["x", "y"]) == ["y"]
    with pytest.raises(ValueError):
        s.extend_records("progress", 0, 0, frames.select("x"))
    s.init_record_fields("warping", ["walker_idx"])
    with pytest.raises(ValueError):
        s.append("warping", spark.createDataFrame([(0, 0, 1)], "run_idx long, cycle_idx long, other long"))
    s.set_snapshot_hash(0, "end", "h")
    with pytest.raises(AttributeError):
        s.set_snapshot_hash(0, "end", "g")


def test_layout_rows():
    assert layout.spread(np.array([0.0, 0.0, 5.0]), np.full(3, 0.5)).tolist() == pytest.approx([-1 / 3, 2 / 3, 14 / 3])
