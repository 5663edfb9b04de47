"""Train, validation and test splits that keep related records together.

Two pairs belong together if they share a file of the same repository, however its path is spelled, as target or context, and so do
pairs joined by a chain of such pairs. Files are nodes, pairs are edges between them, and connected components give the groups.

Groups of identical size and label profile form a bundle; only groups of middle size are bundled by steps of both. A min-cost flow
from kinds of bundles over (profile class, split) to splits fills the quotas: rows up to a split's quota of a class cost nothing, rows
beyond it cost their deviation; a group that would be a large part of a small split goes to the largest. The flow's rows
are rounded to whole groups by largest remainder, class by class, then groups are moved one by one between splits as long as that
lessens the deviations of rows and labels. Groups are dealt by exact hash rank; in large bundles they are counted by the head of
their hash and ranked only inside the heads that hold a boundary, which gives the same ranks, so no bundle is gathered in one task.

Defined cases: repeated rows count once; a pair without usable ids is a group of its own; a null repository is one of its own name;
null labels are a label value; more rows in one group than a quota holds go to the split where they deviate least."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.functions.paths import id_path
from quarrykit.operators.components import connected_components
from quarrykit.runtime import cut_lineage, read_table

SHARES = (("train", 0.8), ("valid", 0.1), ("test", 0.1))
#: Groups up to this size, and the LARGEST groups, are bundled by exact size and labels, others by powers of SIZE_STEP; steps of the label share.
EXACT_SIZE, LARGEST, SIZE_STEP, PROFILE_STEPS = 12, 1000, 1.1, 4
#: Bundles of a split, the largest first, whose groups are tried for changing places.
SWAPS = 300
#: Part of a split's quota that one group may make, unless the split is the largest.
ONE_GROUP = 0.25
#: Bundles of at most this many groups are ranked in one task each; larger ones get the same ranks by heads of 12 bits of the hash.
FEW = 4096


def grouped(pairs: DataFrame) -> DataFrame:
    """(pair_no, group_no) of every pair: group_no is the smallest pair_no of its group.

    A file's node is the least of its ends, 2 * pair_no + side: exact, and the least node of a component names the group."""
    p = pairs.select("pair_no", F.coalesce("repo", F.lit("")).alias("repo"), id_path(F.col("target_id")).alias("a"), id_path(F.col("context_id")).alias("b")).dropDuplicates(["pair_no"])
    ends = p.select("pair_no", "repo", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("path")), F.struct(F.lit(1).alias("side"), F.col("b").alias("path")))).alias("e"))
    ends = ends.select("repo", F.col("e.path").alias("path"), "pair_no", (2 * F.col("pair_no") + F.col("e.side")).alias("end")).where("path is not null")
    nodes = ends.groupBy("repo", "path").agg(F.min("end").alias("node"))
    linked = cut_lineage(ends.join(nodes, ["repo", "path"]).groupBy("pair_no").agg(F.min("node").alias("v"), F.max("node").alias("u")))
    comp = connected_components(linked.select("u", "v"))
    by_node = linked.join(comp, linked.v == comp.node, "left").select("pair_no", F.floor(F.coalesce("component", "v") / 2).cast("bigint").alias("least"))
    return p.select("pair_no").join(by_node, "pair_no", "left").select("pair_no", F.coalesce("least", "pair_no").alias("group_no"))


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow of each arc (from, to, capacity, cost) of a maximum flow of least cost, by successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    potential = [0] * n
    while True:
        far, via = [float("inf")] * n, [-1] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if cap[e] > 0 and d + cost[e] + potential[x] - potential[to[e]] < far[to[e]]:
                    far[to[e]] = d + cost[e] + potential[x] - potential[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (far[to[e]], to[e]))
        if far[sink] == float("inf"):
            return [cap[2 * i + 1] for i in range(len(arcs))]
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        x, push = sink, float("inf")
        while x != source:
            push = min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def allocate(bundles: list[tuple[int, float, int, int]], shares: tuple[tuple[str, float], ...] = SHARES, labels: list[tuple[float, float]] | None = None) -> list[list[int]]:
    """Groups of each bundle for each split. A bundle is (profile class, size of a group, groups, rows); labels are the positive and
    the unset rows of each of its groups."""
    k = len(shares)
    classes = sorted({b[0] for b in bundles})
    rows = {c: sum(b[3] for b in bundles if b[0] == c) for c in classes}
    total = sum(rows.values())
    largest = max(range(k), key=lambda s: shares[s][1])
    # bundles of one class that may go to the same splits are one node: the flow can't tell them apart
    may = [tuple(s for s in range(k) if s == largest or size <= max(1, ONE_GROUP * shares[s][1] * total)) for _, size, _, _ in bundles]
    nodes = sorted({(b[0], m) for b, m in zip(bundles, may)})
    supply = {v: sum(b[3] for b, m in zip(bundles, may) if (b[0], m) == v) for v in nodes}
    first = 1 + len(nodes)
    mid = {(c, s): first + i * k + s for i, c in enumerate(classes) for s in range(k)}
    split0 = first + len(classes) * k
    sink = split0 + k
    arcs, where = [], {}
    for i, (c, m) in enumerate(nodes):
        arcs.append((0, 1 + i, supply[c, m], 0))
        for s in m:
            where[(c, m), s] = len(arcs)
            arcs.append((1 + i, mid[c, s], supply[c, m], 0))
    for c in classes:
        for s, quota in enumerate(_quotas(rows[c], shares)):
            arcs.append((mid[c, s], split0 + s, quota, 0))
            arcs.append((mid[c, s], split0 + s, total, 2))
    for s, quota in enumerate(_quotas(total, shares)):
        arcs.append((split0 + s, sink, quota, 0))
        arcs.append((split0 + s, sink, total, 5))
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    out: list[list[int]] = [[0] * k for _ in bundles]
    left = {v: [float(flow[where[v, s]]) if (v, s) in where else 0.0 for s in range(k)] for v in nodes}
    # large groups first; what a node's splits still want is made good by its smaller ones
    for i in sorted(range(len(bundles)), key=lambda i: -bundles[i][1]):
        c, size, groups, n = bundles[i]
        want = left[c, may[i]]
        size = n / groups
        of_all = n / max(1.0, sum(x for x in want if x > 0))
        got = [int(max(0.0, w) * min(1.0, of_all) // size) if s in may[i] else 0 for s, w in enumerate(want)]
        while sum(got) > groups:
            s = max((s for s in range(k) if got[s] > 0), key=lambda s: got[s] * size - want[s])
            got[s] -= 1
        while sum(got) < groups:
            s = max(may[i], key=lambda s: want[s] - got[s] * size)
            got[s] += 1
        out[i] = got
        left[c, may[i]] = [w - g * size for w, g in zip(want, got)]
    return _settled(out, bundles, may, labels or [(0.0, 0.0)] * len(bundles), shares)


def _quotas(n: int, shares: tuple[tuple[str, float], ...]) -> list[int]:
    """Whole rows of each share; the last takes what is left."""
    out = [round(n * share) for _, share in shares[:-1]]
    return [*out, max(0, n - sum(out))]


def _settled(got: list[list[int]], bundles: list, may: list, labels: list[tuple[float, float]], shares: tuple[tuple[str, float], ...]) -> list[list[int]]:
    """Groups moved between splits, or changing places, as long as that lessens the sum of the deviations of rows, positive and unset rows."""
    if not bundles:
        return got
    g = np.array(got)
    per = np.array([[b[3] / b[2], *label] for b, label in zip(bundles, labels)])
    ok = np.array([[s in m for s in range(len(shares))] for m in may])
    quota = np.array([share for _, share in shares])[:, None] * (per * np.array([b[2] for b in bundles])[:, None]).sum(axis=0)
    held = g.T @ per
    step = 1 << int(g.max()).bit_length()
    while step:
        best, move = -1e-9, None
        dev = np.abs(held - quota).sum(axis=1)
        for a in range(len(shares)):
            for b in range(len(shares)):
                if a != b:
                    can = (g[:, a] >= step) & ok[:, b]
                    if can.any():
                        gain = np.abs(held[a] - step * per - quota[a]).sum(axis=1) + np.abs(held[b] + step * per - quota[b]).sum(axis=1) - dev[a] - dev[b]
                        i = int(np.where(can, gain, np.inf).argmin())
                        if gain[i] < best:
                            best, move = gain[i], (i, a, b)
        if move is None and step == 1:  # no group alone helps: two that change places
            for a in range(len(shares)):
                for b in range(a):
                    left, right = (np.flatnonzero((g[:, x] > 0) & ok[:, y]) for x, y in ((a, b), (b, a)))
                    left, right = left[np.argsort(-g[left, a], kind="stable")][:SWAPS], right[np.argsort(-g[right, b], kind="stable")][:SWAPS]
                    if len(left) and len(right):
                        change = per[left][:, None] - per[right][None, :]
                        gain = np.abs(held[a] - change - quota[a]).sum(axis=2) + np.abs(held[b] + change - quota[b]).sum(axis=2) - dev[a] - dev[b]
                        i, j = np.unravel_index(int(gain.argmin()), gain.shape)
                        if gain[i, j] < best:
                            best, move = gain[i, j], (left[i], a, b, right[j])
        if move is None:
            step //= 2
            continue
        i, a, b, *back = move
        for x, y, z in ((i, a, b), *((j, b, a) for j in back)):
            g[x, y] -= step
            g[x, z] += step
            held[y] -= step * per[x]
            held[z] += step * per[x]
    return g.tolist()


def assign(members: DataFrame, labels: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """(pair_no, group_no, split) of every pair. `members` has pair_no, group_no; `labels` has pair_no, label.

    The driver gets one row of each bundle: exact sizes and labels up to EXACT_SIZE, at most LARGEST large groups, and powers of
    SIZE_STEP times label profiles between - some thousands at most, whatever the corpus."""
    m = cut_lineage(members.join(labels.dropDuplicates(["pair_no"]), "pair_no", "left").withColumn("positive", (F.coalesce("label", F.lit(0)) > 0).cast("int")).withColumn("unset", F.col("label").isNull().cast("int")))
    groups = cut_lineage(m.groupBy("group_no").agg(F.count(F.lit(1)).alias("size"), F.sum("positive").alias("positive"), F.sum("unset").alias("unset")))
    # the size below the largest groups; fewer than LARGEST are above it
    beyond = groups.select("size").orderBy(F.col("size").desc()).limit(LARGEST).agg(F.min("size")).first()[0] or 0
    exact = (F.col("size") <= EXACT_SIZE) | (F.col("size") > beyond)
    size_class = F.when(exact, F.col("size")).otherwise(-F.ceil(F.log(F.col("size") / EXACT_SIZE) / F.log(F.lit(SIZE_STEP))))
    steps = lambda part: F.round(F.col(part) / F.col("size") * PROFILE_STEPS).cast("int")
    key = ["profile", "size_class", "pos", "none"]
    groups = cut_lineage(groups.select(
        "*", (steps("positive") + (PROFILE_STEPS + 1) * steps("unset")).alias("profile"), size_class.cast("bigint").alias("size_class"),
        F.when(exact, F.col("positive")).otherwise(-1).alias("pos"), F.when(exact, F.col("unset")).otherwise(-1).alias("none"), F.xxhash64("group_no").alias("h")))
    spark = m.sparkSession
    rows = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("rows"), F.sum("positive").alias("positive"), F.sum("unset").alias("unset")).orderBy(*key).collect()
    if not rows:
        return members.withColumn("split", F.lit(None).cast("string"))
    got = allocate([(r["profile"], r["rows"] / r["groups"], r["groups"], r["rows"]) for r in rows], shares, [(r["positive"] / r["groups"], r["unset"] / r["groups"]) for r in rows])
    table = [(*[r[k] for k in key], r["groups"], np.cumsum(g).tolist()) for r, g in zip(rows, got)]
    plan = spark.createDataFrame(table, "profile int, size_class bigint, pos bigint, none bigint, groups bigint, cuts array<bigint>")
    dealt = groups.join(F.broadcast(plan), key)
    few = dealt.where(F.col("groups") <= FEW)
    w = Window.partitionBy(*key).orderBy("h", "group_no")
    few = few.withColumn("place", F.row_number().over(w) - 1)
    many = dealt.where(F.col("groups") > FEW).withColumn("head", F.shiftright("h", 52))
    up_to = Window.partitionBy(*key).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = many.groupBy(*key, "head").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    many = many.join(heads, [*key, "head"]).withColumn("parted", F.exists("cuts", lambda c: (c > F.col("ahead")) & (c < F.col("ahead") + F.col("n"))))
    in_head = Window.partitionBy(*key, "head").orderBy("h", "group_no")
    ranked = many.where("parted").withColumn("place", F.col("ahead") + F.row_number().over(in_head) - 1)
    both = few.unionByName(ranked.unionByName(many.where("not parted").withColumn("place", F.col("ahead"))).drop("head", "n", "ahead", "parted"))
    name = F.lit(shares[-1][0])
    for i in reversed(range(len(shares) - 1)):
        name = F.when(F.col("place") < F.col("cuts")[i], shares[i][0]).otherwise(name)
    return m.select("pair_no", "group_no").join(both.select("group_no", name.alias("split")), "group_no")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cut_lineage(grouped(read_table(spark, sf_dir, "training_pair")))
    many = g.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_no")
    return g.join(many, "group_no").select("pair_no", "group_no")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every pair."""
    pairs = read_table(spark, sf_dir, "training_pair")
    return assign(grouped(pairs), pairs.select("pair_no", "label"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, groups and share of positive labels of each new split."""
    pairs = read_table(spark, sf_dir, "training_pair")
    s = assign(grouped(pairs), pairs.select("pair_no", "label")).join(pairs.select("pair_no", "label").dropDuplicates(["pair_no"]), "pair_no")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("group_no").alias("groups"), F.avg((F.col("label") > 0).cast("double")).alias("positive"))


#: Path of an id in normal form: forward slashes, no empty, `.` or `..` steps.
_PATH = """CASE WHEN contains({0}, '@') THEN array_to_string(list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(list_filter(string_split(replace(trim(split_part({0}, '@', -1), ' '), '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])),
lambda a, b: CASE WHEN b[1] = '..' THEN list_slice(a, 1, len(a) - 1) ELSE list_concat(a, b) END), '/') END"""
SQL = {"p4_found": f"""WITH RECURSIVE d AS (SELECT DISTINCT pair_no, coalesce(repo, '') AS repo, {_PATH.format('target_id')} AS a, {_PATH.format('context_id')} AS b FROM training_pair),
e AS (SELECT pair_no, repo, a AS f FROM d WHERE a IS NOT NULL UNION SELECT pair_no, repo, b FROM d WHERE b IS NOT NULL),
r AS (SELECT pair_no AS root, pair_no AS p FROM d UNION SELECT r.root, o.pair_no FROM r JOIN e ON e.pair_no = r.p JOIN e o ON o.repo = e.repo AND o.f = e.f)
SELECT root AS pair_no, min(p) AS group_no FROM r GROUP BY root HAVING count(*) > 1"""}
