"""Local plans, task graphs, schedules and density clusters against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import density, schedule, task_graph
from lodestone.plans.local_plan import LocalPolicy, build_sources, prepare_local
from lodestone.plans.pipeline import Config, Pipeline

UTC = dt.timezone.utc


# ---- schedules


def cron_by_hand(expression, after):
    """Minute by minute (second by second with six fields)."""
    parts = expression.split()
    exact = len(parts) == 6
    ranges = ([(0, 59)] if exact else []) + [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]

    def values(field, low, high):
        out = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, b = (low, 6 if high == 7 else high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]))
            out |= set(range(a, b + 1, int(step or 1)))
        return {v % 7 if high == 7 else v for v in out}

    sets = [values(p, *r) for p, r in zip(parts, ranges)]
    seconds, minutes, hours, days, months, weekdays = sets if exact else [{0}, *sets]
    any_day, any_week = parts[-3] == "*", parts[-1] == "*"
    step = dt.timedelta(seconds=1) if exact else dt.timedelta(minutes=1)
    at = after.replace(microsecond=0) + step if exact else after.replace(second=0, microsecond=0) + step
    for _ in range(2 * 366 * 1440):
        week = (at.weekday() + 1) % 7
        day = True if any_day and any_week else week in weekdays if any_day else at.day in days if any_week else at.day in days or week in weekdays
        if at.month in months and day and at.hour in hours and at.minute in minutes and at.second in seconds:
            return at
        at += step
    return None


def test_cron(spark):
    rng = random.Random(5)
    fields = [["*", "*/7", "0", "5,50", "10-20", "10-40/10"], ["*", "*/6", "23", "0,12"], ["*", "1", "29-31", "15,28"], ["*", "*", "2", "6-8", "12"], ["*", "*", "1-5", "0", "7", "5-7"]]
    rows = []
    for i in range(60):
        after = dt.datetime(2023, 1, 1) + dt.timedelta(seconds=rng.randrange(3 * 365 * 86400), microseconds=rng.randrange(10**6))
        rows.append((i, " ".join(rng.choice(f) for f in fields), after))
    rows += [(100 + i, f"*/{rng.choice((7, 30))} {rng.choice(('*', '3', '59'))} * * * *", dt.datetime(2024, 2, 28, 23, 58, 59) + dt.timedelta(seconds=i * 31)) for i in range(20)]
    rows += [(200, " 0  12 31 12 * ", dt.datetime(2024, 12, 31, 12, 0)), (201, "59 23 * * *", dt.datetime(2024, 12, 31, 23, 58, 30))]
    df = spark.createDataFrame(rows, "id int, e string, t timestamp").withColumn("t", F.make_timestamp_ltz(F.year("t"), F.month("t"), F.day("t"), F.hour("t"), F.minute("t"), F.second("t").cast("decimal(8,6)")))
    text = F.date_format(schedule.next_cron_time(F.col("e"), F.col("t")), "yyyy-MM-dd HH:mm:ss")
    got = {r["id"]: (r["e"], r["t"], r["x"]) for r in df.select("id", "e", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"), text.alias("x")).collect()}
    for e, t, x in got.values():
        want = cron_by_hand(e, dt.datetime.fromisoformat(t))
        assert x == (None if want is None else str(want)) or want is None and int(x[:4]) > int(t[:4]) + 1, (e, t, x, want)


def test_odd_schedules(spark):
    at = "2024-01-31 10:00:00"
    bad = ["* * * *", "61 * * * *", "* 24 * * *", "x * * * *", "5-3 * * * *", "* * 0 * *", "* * * 13 *", "*/0 * * * *", "0 0 30 2 *", "* * * * 8", ", * * * *"]
    df = spark.createDataFrame([(e, at) for e in [*bad, None, "", "hourly", " Weekly ", "0s", "75s", "0 0 29 2 *"]], "e string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r["e"]: r["x"] for r in df.select("e", F.date_format(schedule.next_run(F.col("e"), F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()}
    assert [got[e] for e in bad] == [None] * len(bad)
    assert got[None] == got[""] == "2024-02-01 10:00:00" and got["hourly"] == "2024-01-31 11:00:00" and got[" Weekly "] == "2024-02-07 10:00:00"
    assert got["0s"] == "2024-01-31 10:00:01" and got["75s"] == "2024-01-31 10:01:15" and got["0 0 29 2 *"] == "2024-02-29 00:00:00"
    rows = spark.createDataFrame([("hourly", "2024-01-31 07:30:00"), ("0 6 * * *", "2024-01-31 06:00:00"), ("daily", "2024-02-01 00:00:00")], "interval string, next_run_at string").withColumn("next_run_at", F.col("next_run_at").cast("timestamp"))
    out = {r["interval"]: r["f"] for r in schedule.due(rows, F.lit(at).cast("timestamp")).select("interval", F.date_format("following", "yyyy-MM-dd HH:mm:ss").alias("f")).collect()}
    assert out == {"hourly": "2024-01-31 10:30:00", "0 6 * * *": "2024-02-01 06:00:00"}


# ---- task graphs


def graph(spark, tasks, deps):
    return spark.createDataFrame([(t, n, g) for n, (t, g) in enumerate(tasks)], "task_id string, position int, parallel_group string"), spark.createDataFrame(deps, "task_id string, depends_on string")


def test_task_graph(spark):
    tasks, deps = graph(spark, [("d", "x"), ("a", None), ("b", "x"), ("c", ""), ("e", "y")], [("d", "a"), ("b", "a"), ("e", "d"), ("e", "c"), ("e", "c")])
    assert [(r["task_id"], r["level"]) for r in task_graph.topological_order(tasks, deps).collect()] == [("a", 0), ("c", 0), ("d", 1), ("b", 1), ("e", 2)]
    got = [(r["group_id"], r["tasks"], r["depends_on"], r["level"]) for r in task_graph.parallel_groups(tasks, deps).collect()]
    assert got == [("group_a", ["a"], [], 0), ("group_c", ["c"], [], 0), ("x", ["d", "b"], ["group_a"], 1), ("y", ["e"], ["x", "group_c"], 2)]
    with pytest.raises(ValueError, match="cycle"):
        task_graph.levels(*graph(spark, [("a", None), ("b", None), ("c", None)], [("a", "b"), ("b", "c"), ("c", "b")]))
    with pytest.raises(ValueError, match="cycle"):
        task_graph.levels(*graph(spark, [("a", None)], [("a", "a")]))
    with pytest.raises(ValueError, match="unknown task id 'z'"):
        task_graph.levels(*graph(spark, [("a", None)], [("a", "z")]))
    assert task_graph.levels(*graph(spark, [("a", None)], [])).collect()[0]["level"] == 0


# ---- density


def clusters_by_hand(points, least):
    """Mutual reachability of all pairs, Prim's tree, single linkage by repeated cuts of the longest edges."""
    n = len(points)
    d = np.round(np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(2), 0)), 9)
    core = np.array([sorted(np.delete(d[i], i))[min(least, n - 1) - 1] for i in range(n)])
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    every = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    group, tree = list(range(n)), []
    for w, i, j in every:
        if group[i] != group[j]:
            tree.append((i, j, w))
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    return tree, reach


def cut_by_hand(n, tree, least):
    """Recursion over sets of points: a set is cut at its last edge."""
    clusters = []  # (points, birth, parent, stability)

    def grow(members, edges, birth, parent):
        me = len(clusters)
        clusters.append([set(members), birth, parent, 0.0])
        part(members, edges, me)
        return me

    def part(members, edges, me):
        while edges:
            u, v, w = edges[-1]
            edges = edges[:-1]
            sides = {}
            for start in (u, v):
                seen, todo = {start}, [start]
                while todo:
                    x = todo.pop()
                    for a, b, _ in edges:
                        for p, q in ((a, b), (b, a)):
                            if p == x and q not in seen and q in members:
                                seen.add(q)
                                todo.append(q)
                sides[start] = seen
            lam = 1 / max(w, 1e-12)
            big = [s for s in (u, v) if len(sides[s]) >= least]
            own = lambda s: [e for e in edges if e[0] in sides[s]]  # noqa: B023, E731
            if len(big) == 1:
                gone = v if big[0] == u else u
                clusters[me][3] += (lam - clusters[me][1]) * len(sides[gone])
                members, edges = sides[big[0]], own(big[0])
                continue
            clusters[me][3] += (lam - clusters[me][1]) * len(members)
            if len(big) == 2:
                for s in (u, v):
                    grow(sides[s], own(s), lam, me)
            return

    grow(set(range(n)), tree, 0.0, None)
    best, taken = [c[3] for c in clusters], [False] * len(clusters)
    for c in range(len(clusters) - 1, 0, -1):
        inside = sum(best[x] for x in range(len(clusters)) if clusters[x][2] == c)
        taken[c], best[c] = inside <= best[c], max(inside, best[c])
    label = [-1] * n
    for c in range(len(clusters)):
        up, free = clusters[c][2], taken[c]
        while up is not None:
            free &= not taken[up]
            up = clusters[up][2]
        if free:
            for x in clusters[c][0]:
                label[x] = c
    return label


def partition(labels):
    groups = {}
    for i, c in enumerate(labels):
        groups.setdefault(c if c >= 0 else ("noise", i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_cut_tree():
    rng = np.random.default_rng(3)
    assert density.cut_tree(1, [], 2) == [-1] and density.cut_tree(0, [], 2) == []
    for n, least in ((4, 2), (30, 3), (60, 5), (60, 2)):
        points = np.concatenate([rng.normal(c, 0.3 + 0.2 * k, (n // 3 + 1, 2)) for k, c in enumerate((0, 4, 9))])[:n]
        tree, _ = clusters_by_hand(points, least)
        assert partition(density.cut_tree(n, tree, least)) == partition(cut_by_hand(n, tree, least))


def test_density_clusters(spark):
    rng = np.random.default_rng(9)
    points = np.round(np.concatenate([rng.normal((0, 0), 0.2, (25, 2)), rng.normal((5, 1), 0.4, (25, 2)), rng.uniform(-8, 8, (12, 2)), [[5.0, 1.0]] * 3]), 3)
    rows = [(int(i) * 2, v) for i, v in enumerate(points.tolist())]
    df = spark.createDataFrame([*rows, rows[0], (None, [1.0, 1.0]), (999, None)], "chunk_id long, embedding array<double>").repartition(3)
    tree, _ = clusters_by_hand(points, 5)
    cores = density.core_distances(spark.createDataFrame(rows, "id long, v array<double>"), 5, block=20)
    got = density.spanning_tree(cores, block=20).collect()
    assert sorted((r["u"] // 2, r["v"] // 2, r["weight"]) for r in got) == sorted(tree)
    labels = density.cut_tree(len(points), tree, 5)
    assert len(set(labels) - {-1}) >= 2 and -1 in labels
    names = {c: k for k, c in enumerate(dict.fromkeys(c for c in labels if c >= 0))}
    labels = np.array([names.get(c, -1) for c in labels])
    centers = np.array([points[labels == k].mean(0) for k in range(len(names))])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(unit(points) @ unit(centers).T, 9).argmax(1)
    found, middles = density.density_clusters(df, 5, block=20)
    assert {r["chunk_id"]: r["cluster_id"] for r in found.collect()} == {2 * i: int(near[i] if labels[i] < 0 else labels[i]) for i in range(len(points))}
    assert sum(r["size"] for r in middles.collect()) == len(points)
    few, _ = density.density_clusters(df.limit(3), 5)
    assert {r["cluster_id"] for r in few.collect()} <= {0}
    assert density.density_clusters(df.limit(0), 5)[0].count() == 0


def test_density_of_copies_and_ties(spark):
    """one of equal vectors stands for all, lists that do not reach another cluster are made anew, the tree stays the same."""
    rng = np.random.default_rng(4)
    grid = rng.integers(0, 3, (70, 2)).astype(float)  # equal vectors, most distances equal
    far = np.concatenate([rng.normal(c, 0.1, (22, 2)) for c in ((0, 0), (30, 1), (70, 40))]).round(3)  # lists of 4 stay inside
    copies = np.repeat(rng.normal(0, 1, (12, 2)).round(2), 6, axis=0)
    for points, least, name in ((grid, 3, str), (far, 2, int), (rng.permutation(copies), 5, int)):
        ids = [name(i + 100) for i in range(len(points))]
        rows = spark.createDataFrame(list(zip(ids, points.tolist())), f"id {'string' if name is str else 'long'}, v array<double>").repartition(3)
        cores = density.core_distances(rows, least, block=16)
        tree, _ = clusters_by_hand(points, least)
        assert sorted(map(tuple, density.spanning_tree(cores, block=16).collect())) == sorted((ids[u], ids[v], w) for u, v, w in tree)
        kept = cores.select("id", "first", "copies", "near").collect()
        assert {r["first"] for r in kept} == {r["id"] for r in kept if r["near"]} and len({r["first"] for r in kept}) == len(np.unique(points, axis=0))
        assert max(len(r["near"] or []) for r in kept) <= 2 * least


def test_density_of_the_tables(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(200).collect())
    points = np.array([v for _, v in rows], float)
    tree, _ = clusters_by_hand(points, 5)
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    got = density.spanning_tree(density.core_distances(frame, 5))
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert sorted((at[r["u"]], at[r["v"]], r["weight"]) for r in got.collect()) == sorted(tree)


# ---- local plans


def test_local_plan(spark):
    rows = [("a1", "/x/a.md", ".md", "alpha beta", True, [1.0, 0.0]), ("a2", "/x/a.md", ".md", "gamma", True, [0.9, 0.1]), ("a3", "/x/a.md", ".md", "delta", True, [0.8, 0.2]), ("b1", "/y/b.txt", ".txt", "alpha", True, [0.7, 0.3]), ("c1", "/y/c", None, "eps", True, [0.1, 0.9]), ("old", "/y/o", None, "alpha", False, [1.0, 0.0])]
    chunks = spark.createDataFrame([(*r, "en" if r[0] < "b" else "de") for r in rows], "chunk_id string, source_path string, ext string, text string, is_current boolean, embedding array<double>, lang string")
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "none", [0.0, 1.0])], "query_id int, query string, embedding array<double>")
    order = lambda plan: {q: [r["cid"] for r in sorted(plan.filtered.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2)}
    plain = prepare_local(chunks, queries, LocalPolicy(k=5))
    assert order(plain) == {1: ["a1", "b1", "a2", "c1"], 2: ["c1", "b1", "a3", "a2"]}  # lexical hits first, two of a file
    assert {r["query_id"]: round(r["relevance"], 6) for r in plain.relevance.collect()}[1] == 1.0
    some = prepare_local(chunks, queries, LocalPolicy(k=5, path_contains=["/X/"]), pinned=spark.createDataFrame([(2, "old"), (2, "a1")], "query_id int, cid string"))
    assert some.policy.depth == 15 and order(some)[1] == ["a1", "a2"] and order(some)[2][0] == "old"
    conditions = spark.createDataFrame([(1, "lang", "de"), (1, "ext", ".txt"), (2, "lang", "fr")], "query_id int, field string, value string")
    narrow = prepare_local(chunks, queries, LocalPolicy(k=5), conditions)
    assert order(narrow)[1] == ["b1"] and len(order(narrow)[2]) == 4  # nothing is French: searched without
    fixed = prepare_local(chunks, queries, LocalPolicy(k=2), anchors=spark.createDataFrame([(1, "c1")], "query_id int, cid string"), anchor_files=spark.createDataFrame([(1, "/x/a.md")], "query_id int, source_path string"))
    assert order(fixed)[1][:3] == ["c1", "a1", "a2"]
    off = prepare_local(chunks, queries, LocalPolicy(enabled=False))
    assert off.filtered.count() == 0 and {r["relevance"] for r in off.relevance.collect()} == {0.0}

    run = Pipeline(chunks.withColumn("heading_path", F.array().cast("array<string>")), Config("dense_only", k=2, dedup_threshold=None))
    remote = spark.createDataFrame([(1, "r1", 0.99, "t", "http://r"), (1, "r2", 0.2, "t", "http://s")], "query_id int, cid string, score double, text string, source_path string")
    sources, trace = build_sources(run, queries, remote)
    assert [r["cid"] for r in sources.where("query_id = 1").orderBy("rank").collect()][:2] == ["a1", "r1"] or sources.where("query_id = 1").count() == 4
    assert {r["query_id"]: (r["n_local"], r["n_remote"]) for r in trace.collect()} == {1: (2, 2), 2: (2, 0)}
