"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are aggregated by membership
pattern; every pattern offers its words once for free, a second time at cost
1, a third at cost 2 (convex repetition costs), up to ``max_epochs``; every
source asks for its target.  The cheapest flow from patterns to sources says
how many words of a pattern the mix takes: whole passes, plus a remainder that
is filled with seeded documents.

The flow network has one node per pattern and source, built from aggregated
sums; documents never reach the driver.  The remainder of a pattern is a
prefix of its documents in the order of a seeded hash: sums per hash bucket
find the bucket where the quota ends, and only that bucket is ordered row by
row, so a hot pattern is spread over all tasks.  What is left below the next
document is evened out by moving a few documents whose sizes fit.

Defined cases: null text has size 0 (never over its target, copies follow the
passes of its pattern); a null source is a source of its own, after all
others; a document without sources is not taken; a document repeated in the
table is one unit whose rows are taken together; a mix of nothing (empty
table, all sizes 0) takes nothing; extra columns are carried by ``mix``.
"""
from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from riskloom.llm.common import free_name, match_key, text_of, words_of, written
from riskloom.session import broadcast_if_small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 7
#: Hash buckets per pattern; a resolution, not a limit.
BUCKETS = 4096
#: Moves that bring a pattern closer to its quota, in order.
ROUNDS = ("add", "add", "over", "remove", "remove", "remove")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE,
            max_epochs: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Words asked of every source: weights in cyclic order over the sources
    by code point (null last), no source above ``max_epochs`` times its size,
    the excess shared out again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = dict.fromkeys(names, 0.0)
    open_ = set(names)
    left = share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in names if s in open_)
        over = [s for s in names if s in open_ and left * weight[s] / total > max_epochs * sizes[s]]
        if not over:
            for s in open_:
                out[s] = left * weight[s] / total
            break
        for s in over:
            out[s] = float(max_epochs * sizes[s])
            open_.remove(s)
        left -= sum(out[s] for s in over)
    return out


def cheapest_flow(patterns: list[tuple[tuple, float]], wanted: dict, max_epochs: int = MAX_EPOCHS) -> list[dict]:
    """Words each pattern sends to each of its sources: maximum flow of least
    repetition cost.  Epoch by epoch the patterns' capacity is raised by their
    size and flow is augmented along level graphs; an augmenting path costs
    what its first arc costs, so this is cheapest-path order."""
    names = list(wanted)
    index = {s: i for i, s in enumerate(names)}
    n, m = len(patterns), len(names)
    start, end = n + m, n + m + 1
    to, cap, out = [], [], [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: float) -> int:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, 0.0))
        return len(to) - 2

    entry = [arc(start, i, 0.0) for i in range(n)]
    middle = [[(s, arc(i, n + index[s], float("inf"))) for s in members if s in index]
              for i, (members, _) in enumerate(patterns)]
    for s in names:
        arc(n + index[s], end, float(wanted[s]))
    eps = 1e-9 * max([1.0, *wanted.values()])
    for _ in range(max_epochs):
        for i, (_, size) in enumerate(patterns):
            cap[entry[i]] += size
        while True:
            level = {start: 0}
            queue = deque([start])
            while queue:
                a = queue.popleft()
                for e in out[a]:
                    if cap[e] > eps and to[e] not in level:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if end not in level:
                break
            at = [0] * len(out)
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    path, node = [], start
                    continue
                while at[node] < len(out[node]):
                    e = out[node][at[node]]
                    if cap[e] > eps and level.get(to[e], -1) == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(out[node]):
                    path.append(out[node][at[node]])
                    node = to[path[-1]]
                elif path:
                    node = to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break
    return [{s: cap[e ^ 1] for s, e in arcs} for arcs in middle]


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def plan(docs: DataFrame, members: Column, text: str = "text", weights=WEIGHTS, share: float = SHARE,
         max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(units, sources): units hold doc_id, pattern, size, n_rows and copies;
    sources hold source, source_size and target."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.to_json(F.array_sort(F.array_distinct(members))).alias("pattern"),
                       word_count(text_of(text)).alias("size"))
    units = written(rows.groupBy("doc_id", "pattern", "size").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "*", F.xxhash64(F.lit(seed), "doc_id", "size").alias("u"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 52).cast("int").alias("bucket")), "mix-units")
    words = F.sum(F.col("size") * F.col("n_rows"))
    buckets = written(units.groupBy("pattern", "bucket").agg(words.alias("words")), "mix-buckets")
    listed = buckets.groupBy("pattern").agg(F.sum("words").alias("words")).select(
        "pattern", F.from_json("pattern", "array<string>").alias("members"), "words").collect()  # one row per pattern
    sizes: dict[str | None, int] = {}
    for p in listed:
        for s in p["members"] or []:
            sizes[s] = sizes.get(s, 0) + p["words"]
    wanted = targets(sizes, weights, share, max_epochs)
    flow = cheapest_flow([(tuple(p["members"] or ()), float(p["words"])) for p in listed], wanted, max_epochs)
    quotas = []
    for p, f in zip(listed, flow):
        total = sum(f.values())
        passes = min(int(total / p["words"] + 1e-9), max_epochs) if p["words"] else 0
        quotas.append((p["pattern"], passes, max(total - passes * p["words"], 0.0)))
    quota = broadcast_if_small(spark.createDataFrame(
        quotas, "pattern string, passes int, quota double"))
    sources = spark.createDataFrame([(s, sizes[s], wanted[s]) for s in wanted],
                                    "source string, source_size bigint, target double")
    # the bucket in which the quota of a pattern ends
    w = Window.partitionBy("pattern").orderBy("bucket")
    cuts = (buckets.withColumn("upto", F.sum("words").over(w)).join(quota, "pattern")
            .where("upto > quota").groupBy("pattern").agg(
                F.min_by("bucket", "bucket").alias("cut"), F.min(F.col("upto") - F.col("words")).alias("before")))
    ends = written(quota.join(cuts, "pattern", "left").select(
        "pattern", "passes", "quota", F.coalesce("cut", F.lit(BUCKETS)).alias("cut"),
        F.coalesce("before", F.lit(0)).alias("before")), "mix-ends")
    known = units.join(broadcast_if_small(ends), "pattern")
    weight = F.col("size") * F.col("n_rows")
    inside = known.where("bucket = cut").withColumn(
        "run", F.col("before") + F.sum(weight).over(Window.partitionBy("pattern").orderBy("u", "doc_id", "size")))
    cut_rows = inside.select("doc_id", "pattern", "size", "n_rows", "u", "passes", "quota",
                             (F.col("run") <= F.col("quota")).alias("extra"))
    rest = known.where("bucket <> cut").select("doc_id", "pattern", "size", "n_rows", "u", "passes", "quota",
                                               (F.col("bucket") < F.col("cut")).alias("extra"))
    chosen = written(rest.union(cut_rows), "mix-chosen")
    return _topped_up(chosen).select(
        "doc_id", "pattern", "size", "n_rows",
        F.least(F.col("passes") + F.col("extra").cast("int"), F.lit(max_epochs)).alias("copies")), sources


def _topped_up(chosen: DataFrame) -> DataFrame:
    """Bring each pattern closer to its quota by moving a few documents, one
    per pattern and round: add the largest that still fits, add the smallest
    above what is left, then remove the largest within the excess.  The last
    two kinds count only for patterns that end closer to their quota."""
    weight = F.col("size") * F.col("n_rows")
    left = written(chosen.groupBy("pattern").agg(
        (F.first("quota") - F.coalesce(F.sum(F.when(F.col("extra"), weight)), F.lit(0))).alias("left")), "mix-left")
    before = None
    moves = None
    for kind in ROUNDS:
        if kind == "over" and before is None:
            before = left
        room = F.col("left") if kind != "remove" else -F.col("left")
        far = weight - room
        open_ = (chosen.where(F.col("size") > 0).where(F.col("extra") if kind == "remove" else ~F.col("extra"))
                 .join(broadcast_if_small(left), "pattern").where(room > 0)
                 .where(far > 0 if kind == "over" else far <= 0))
        if moves is not None:
            open_ = match_key(open_, broadcast_if_small(moves), ["pattern", "doc_id", "size"], "left_anti")
        best = written(open_.groupBy("pattern").agg(F.min_by(
            F.struct("doc_id", "size", weight.alias("weight")), F.struct(F.abs(far).alias("far"), F.col("u"))).alias("b"))
            .select("pattern", "b.doc_id", "b.size", (F.lit(-1 if kind == "remove" else 1) * F.col("b.weight")).alias("w"),
                    F.lit(before is not None).alias("late")), "mix-move")
        left = written(left.join(best.select("pattern", "w"), "pattern", "left").select(
            "pattern", (F.col("left") - F.coalesce("w", F.lit(0))).alias("left")), "mix-left")
        moves = best if moves is None else moves.union(best)
    better = left.join(before.withColumnRenamed("left", "was"), "pattern").select(
        "pattern", (F.abs("left") < F.abs("was")).alias("better"))
    flips = written(moves.join(better, "pattern").where("better or not late")
                    .select("pattern", "doc_id", "size", F.lit(True).alias("flip")), "mix-flips")
    marked = match_key(chosen, broadcast_if_small(flips), ["pattern", "doc_id", "size"], "left")
    return marked.withColumn("extra", F.col("extra") != F.coalesce("flip", F.lit(False)))


def mixture(docs: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, each document
    belonging to the one source named in its row."""
    units, sources = plan(docs, F.array(F.col(source).cast(T.StringType())), text, **options)
    named = units.withColumn("source", F.get(F.from_json("pattern", "array<string>"), F.lit(0)))
    rows = match_key(named, broadcast_if_small(sources), ["source"], "left")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("col")


def mix(docs: DataFrame, members: Column, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    units, _ = plan(docs, members, text, **options)
    p, s, c, k = (free_name(docs, x) for x in ("_pattern", "_size", "_copies", "_copy"))
    marked = docs.withColumn(p, F.to_json(F.array_sort(F.array_distinct(members)))).withColumn(
        s, word_count(text_of(text)))
    wanted = units.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("pattern").alias("__p"),
                                              F.col("size").alias("__s"), F.col("copies").alias(c))
    cond = marked["doc_id"].eqNullSafe(wanted["__id"]) & (marked[p] == wanted["__p"]) & (marked[s] == wanted["__s"])
    return (marked.join(wanted, cond).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(c))))
            .select(*[f"`{x}`" for x in docs.columns]))
