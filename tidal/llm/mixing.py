"""Mixing sources to target weights: a min-cost flow over membership patterns.

Documents may belong to several sources.  Those with the same set of sources
form a pattern; only the patterns' word totals reach the driver.  Words flow
from a pattern, whose first, second, ... use costs 0, 1, ... (convex, so nothing
is repeated while fresh words fit), through its sources into their quotas.
Then documents of each pattern are selected in seeded order, on the executors,
until the pattern's flow is reached.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidal.llm.common import WORD
from tidal.session import materialize

#: Documents of a pattern taken beyond the cut at most, each the largest that fits.
FILLS = 4

#: Largest documents of a pattern that are settled one by one.
LARGE = 8

#: Patterns the driver plans at most.  More is an error, never a silent cut.
MAX_PATTERNS = 200_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: list[int], weights: list[int], total: int, most: int) -> list[float]:
    """``total`` shared by weight; a target stops at ``most`` times its size, the excess is shared again."""
    left, todo = Fraction(total), [i for i, w in enumerate(weights) if w > 0]
    target = [Fraction(0)] * len(sizes)
    while todo:
        unit = left / sum(weights[i] for i in todo)
        full = [i for i in todo if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in todo:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = Fraction(most * sizes[i])
            left -= target[i]
        gone = set(full)
        todo = [i for i in todo if i not in gone]
    return [float(t) for t in target]


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Words each pattern gives to each of its sources at the least total cost of repetition.

    ``patterns``: (sources, words).  A path that adds flow leaves the origin by
    one pattern only, so its cost is that pattern's next level; filling the
    levels in order of cost, each to a maximum flow, is therefore a min-cost flow.
    """
    n, m = len(patterns), len(quotas)
    end = n + m
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(u: int, v: int, c: int) -> int:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(0)
        return len(to) - 2

    links = [{s: arc(p, n + s, most * words) for s in sources} for p, (sources, words) in enumerate(patterns)]
    for s, q in enumerate(quotas):
        arc(n + s, end, q)
    for _ in range(most):
        supply = [words for _, words in patterns]
        while True:
            # depths towards the end, over arcs with room
            depth = [-1] * (end + 1)
            depth[end] = 0
            queue = deque([end])
            while queue:
                v = queue.popleft()
                for e in out[v]:
                    if cap[e ^ 1] and depth[to[e]] < 0:
                        depth[to[e]] = depth[v] + 1
                        queue.append(to[e])
            nxt = [0] * (end + 1)
            moved = False
            for p in range(n):
                while supply[p] and depth[p] > 0:
                    path: list[int] = []
                    u = p
                    while u != end:
                        while nxt[u] < len(out[u]):
                            e = out[u][nxt[u]]
                            if cap[e] and 0 <= depth[to[e]] == depth[u] - 1:
                                break
                            nxt[u] += 1
                        else:
                            if not path:
                                break
                            u = to[path.pop() ^ 1]
                            nxt[u] += 1
                            continue
                        path.append(e)
                        u = to[e]
                    if u != end:
                        break
                    flow = min(supply[p], *(cap[e] for e in path))
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    supply[p] -= flow
                    moved = True
            if not moved:
                break
    return [{s: cap[e ^ 1] for s, e in link.items()} for link in links]


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, doc_id: str = "doc_id",
        text: str = "text", sources: str = "source", key: str | None = None) -> DataFrame:
    """doc_id, sources, size, source_size, target, taken, repeats (and column ``key``, if named): one row per row of ``docs``.

    ``sources`` is a string (one source; null is a source of its own) or an
    array of strings (an empty or null array: the null source).  Sources in
    code-point order, null last, weigh ``weights``, repeating, and share the
    words of all documents; a target stops at ``most`` times its source's
    words.  ``source_size`` and ``target`` are those of the first source.
    A document is taken whole, ``repeats`` times, at most ``most``.

    Null text has size 0, documents of size 0 are never taken, repeated rows
    count each, an empty table gives no rows; other columns are not read.
    Order within a pattern is a seeded hash of the row (id, text, sources), so
    reruns agree; rows that are equal in all of these stand next to each other
    and are cut by their number.  The cut is found by rounds of sums over parts
    of that order, not by one ordered group.  It stops before the document that
    would pass the target; the largest documents that still fit follow.  The
    few largest of a pattern are settled first, by a seeded coin of the
    pattern's share, or by need where the others cannot make up for them.
    """
    spark = docs.sparkSession
    several = dict(docs.dtypes)[sources].startswith("array")
    member = F.col(sources).cast("array<string>" if several else "string")
    if several:
        member = F.when(F.size(member) > 0, F.sort_array(F.array_distinct(member), asc=True)).otherwise(
            F.array(F.lit(None).cast("string")))
    else:
        member = F.array(member)
    whole = [F.col(c).cast("string") for c in (doc_id, text)] + [F.to_json("sources")]
    order = F.xxhash64(F.lit(seed), *(x for c in whole for x in (c.isNull(), c)))
    sized = materialize(
        docs.withColumn("sources", member)
        .select(F.col(doc_id).cast("long").alias("doc_id"), "sources", word_count(text).alias("size"),
                F.to_json("sources").alias("pattern"), order.alias("order"),
                F.monotonically_increasing_id().alias("row"), *([key] if key else []))
        .withColumn("high", F.shiftrightunsigned("order", 52)).withColumn("low", F.pmod("order", F.lit(4096)))
        .withColumn("tie", F.xxhash64("row")).withColumn("tie_high", F.shiftrightunsigned("tie", 52)), "mix-sized")

    rows = (sized.groupBy("pattern").agg(F.any_value("sources").alias("sources"), F.sum("size").alias("words"))
            .limit(MAX_PATTERNS + 1).collect())
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    names = sorted({s for r in rows for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for r in rows:
        for s in r["sources"]:
            size[number[s]] += r["words"]
    weigh = [weights[i % len(weights)] for i in range(len(names))]
    target = share_targets(size, weigh, sum(r["words"] for r in rows), most)
    flows = route([(tuple(number[s] for s in r["sources"]), r["words"]) for r in rows],
                  [round(t) for t in target], most)
    plan = {}
    for r, f in zip(rows, flows):
        times, rest = divmod(sum(f.values()), r["words"]) if r["words"] else (0, 0)
        first = number[r["sources"][0]]
        plan[r["pattern"]] = (times, rest, size[first], target[first], r["words"])

    def planned(columns: str, at: dict[str, tuple]) -> DataFrame:
        """A row for each pattern, at most MAX_PATTERNS."""
        return F.broadcast(spark.createDataFrame([(p, *v) for p, v in at.items()], f"pattern string, {columns}"))

    docs_ = sized.join(planned("times long, rest long, source_size long, target double, words long", plan), "pattern")

    # the largest documents of each pattern are settled one by one, so that the others are small beside their words
    by_size = Window.partitionBy("pattern").orderBy(F.desc("size"), "order", "row")
    large = (docs_.filter("rest > 0 AND size > 0").withColumn("n", F.row_number().over(by_size)).filter(F.col("n") <= LARGE)
             .select("pattern", "row", "size", "order", "n").collect())
    settled: list[tuple[str, int, bool]] = []
    left = {p: (rest, words) for p, (_, rest, _, _, words) in plan.items() if rest}
    for r in sorted(large, key=lambda r: (r["pattern"], r["n"])):
        p, n = r["pattern"], r["size"]
        rest, words = left[p]
        others = words - n
        if n <= rest:
            coin = (r["order"] % (1 << 64)) * plan[p][4] < plan[p][1] << 64
            take = coin or others < rest
        else:  # passes the target: only where leaving it misses by more
            take = rest > 0 and rest - others > n - rest
        settled.append((p, r["row"], take))
        left[p] = (max(0, rest - n) if take else rest, others)
    full = {p: (rest, rest >= words, rest - words) for p, (rest, words) in left.items()}
    docs_ = (docs_.join(F.broadcast(spark.createDataFrame(settled, "pattern string, row long, taken_whole boolean")),
                        ["pattern", "row"], "left")  # at most LARGE rows a pattern
             .join(planned("left long, whole boolean, short long", full), "pattern", "left"))

    # the place where a pattern's words end: by parts of the order, then, among equal rows, by their own numbers
    inside = docs_.filter("left >= 0 AND NOT whole AND taken_whole IS NULL AND size > 0")
    cuts, rest, extra = None, "left", F.lit(False)
    at = ["high", "low", "order", "tie_high", "tie"]
    for place in at:
        cut = materialize(_cut(inside, place, rest), f"mix-{place}")
        inside = inside.join(F.broadcast(cut), "pattern").filter(F.col(place) == F.col(f"{place}_cut"))
        cuts = cut if cuts is None else cuts.join(cut, "pattern")
        rest = f"{place}_rest"
    for place in reversed(at):
        extra = (F.col(place) < F.col(f"{place}_cut")) | ((F.col(place) == F.col(f"{place}_cut")) & extra)
    cuts = materialize(cuts.select("pattern", F.col(rest).alias("gap"), *(f"{p}_cut" for p in at)), "mix-cuts")
    cut_docs = docs_.join(F.broadcast(cuts), "pattern", "left").withColumn(
        "extra", F.coalesce(F.col("taken_whole"), F.col("whole") | extra, F.lit(False)))

    # the document at the cut did not fit: the largest that do fill the gap, a few for each pattern
    gaps = {p: short for p, (_, whole, short) in full.items() if whole}
    gaps |= {r["pattern"]: r["gap"] for r in cuts.select("pattern", "gap").collect()}
    picked: list[tuple[str, int]] = []
    for _ in range(FILLS):
        open_ = spark.createDataFrame([(p, g) for p, g in gaps.items() if g > 0], "pattern string, room long")
        taken = spark.createDataFrame(picked, "pattern string, row long")
        found = (cut_docs.filter("NOT extra AND size > 0").join(F.broadcast(open_), "pattern").filter("size <= room")
                 .join(F.broadcast(taken), ["pattern", "row"], "left_anti")
                 .groupBy("pattern").agg(F.max(F.struct("size", "order", "row")).alias("m")).collect())
        if not found:
            break
        for r in found:
            picked.append((r["pattern"], r["m"]["row"]))
            gaps[r["pattern"]] -= r["m"]["size"]
    more = spark.createDataFrame(picked, "pattern string, row long").withColumn("more", F.lit(True))
    chosen = F.col("extra") | F.coalesce(F.col("more"), F.lit(False))
    return (cut_docs.join(F.broadcast(more), ["pattern", "row"], "left")  # at most FILLS rows a pattern
            .withColumn("repeats", F.when(F.col("size") > 0, F.col("times") + chosen.cast("long")).otherwise(0))
            .select("doc_id", "sources", "size", "source_size", "target",
                    (F.col("size") * F.col("repeats")).alias("taken"), F.col("repeats").cast("int").alias("repeats"),
                    *([key] if key else [])))


def _cut(docs: DataFrame, place: str, rest: str) -> DataFrame:
    """For each pattern the place (one of 4096) where ``rest`` words end, and the words left for that place."""
    before = Window.partitionBy("pattern").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("pattern", place).agg(F.sum("size").alias("words"), F.any_value(rest).alias("rest_"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    hit = sums.filter("before <= rest_ AND rest_ < before + words")
    return hit.select("pattern", F.col(place).alias(f"{place}_cut"), (F.col("rest_") - F.col("before")).alias(f"{place}_rest"))
