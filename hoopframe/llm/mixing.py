"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). The flow
runs from patterns to source quotas: each pattern offers its tokens once for free, a second
time at a cost and a third time at a higher one, so repetition is spread as evenly as the
quotas allow. Whole repeats go to every document of a pattern; the rest goes to documents that
still fit, in a seeded order, found by prefix sums over 4096 hash blocks of a pattern in a few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopframe.sources.staging import stage

from .common import WORD

#: Costs of a token's first, second and third use (convex: only their order matters to the flow).
COSTS = (0, 1, 4)
#: Patterns the driver's flow solver takes; more is an error, never a cut. It also bounds the broadcast plan.
MOST_PATTERNS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, most: int = len(COSTS)) -> dict:
    """Quotas that share the total size by weight, none above ``most`` times its source's size.

    What lies above a source's bound is shared again among the others by weight.
    """
    total, out, open_ = float(sum(sizes.values())), {}, dict(weights)
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if total * w / weight > most * sizes[s]]
        if not full:
            out.update({s: total * w / weight for s, w in open_.items()})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            total -= out[s]
            del open_[s]
    return out


def min_cost_flow(supply: dict, quotas: dict) -> dict:
    """Tokens sent from each pattern to each source: {(pattern, source): tokens}.

    supply: {pattern (tuple of sources): tokens}. One node per pattern and source; a pattern's uses
    are the only arcs with a cost, and a path from the start holds one of them. Shortest paths thus
    come use by use: each use is opened for all patterns and filled as far as it goes, along blocking
    flows over levels, before the next one. Quotas are rounded to whole tokens, fractions above one
    half up.
    """
    head: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[], []]  # the start and the end

    def arc(a: int, b: int, capacity: int) -> int:
        out[a].append(len(head))
        out[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((capacity, 0))
        return len(head) - 2

    def node() -> int:
        out.append([])
        return len(out) - 1

    def levels() -> list[int]:
        level, queue = [-1] * len(out), [0]
        level[0] = 0
        for a in queue:
            for e in out[a]:
                if room[e] > 0 and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        return level

    def fill(level: list[int]) -> None:
        """Push along paths of rising levels until none is left."""
        tried, path, a = [0] * len(out), [], 0
        while True:
            if a == 1:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                full = next(i for i, e in enumerate(path) if not room[e])
                a = head[path[full] ^ 1]
                del path[full:]
            arcs, i = out[a], tried[a]
            while i < len(arcs) and not (room[arcs[i]] > 0 and level[head[arcs[i]]] == level[a] + 1):
                i += 1
            tried[a] = i
            if i < len(arcs):
                path.append(arcs[i])
                a = head[arcs[i]]
            elif path:
                a = head[path.pop() ^ 1]
                tried[a] += 1
            else:
                return

    by_name = lambda s: (s is None, s or "")
    ends = {}
    for s in sorted(quotas, key=by_name):
        if quotas[s] > 0:
            ends[s] = node()
            arc(ends[s], 1, int(quotas[s] + 0.5))
    uses, routes = [], {}
    for p, tokens in sorted(supply.items(), key=lambda x: [by_name(s) for s in x[0]]):
        at = node()
        uses.append((arc(0, at, 0), max(0, tokens)))
        for s in p:
            if s in ends:
                routes[p, s] = arc(at, ends[s], len(COSTS) * max(0, tokens))
    for _ in COSTS:
        for e, tokens in uses:
            room[e] += tokens
        while (level := levels())[1] >= 0:
            fill(level)
    return {k: room[e ^ 1] for k, e in routes.items() if room[e ^ 1] > 0}


def plan_mix(rows: DataFrame, weight_of) -> tuple[dict, dict, dict]:
    """Sizes and quotas by source, and the tokens each pattern is asked for.

    rows: ``pattern`` (sorted array of sources) and ``size``. The grouped patterns, one row each,
    are all the driver sees; ``weight_of(i)`` is the weight of the i-th source by code point, null last.
    """
    seen = rows.groupBy("pattern").agg(F.sum("size").alias("size")).take(MOST_PATTERNS + 1)
    if len(seen) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns: group rare sources first")
    supply = {tuple(r["pattern"]): r["size"] for r in seen}
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(supply.values())
    weights = {s: weight_of(i) for i, s in enumerate(names)}
    quotas = targets(sizes, weights) if len(supply) == len(sizes) else _overlapping(sizes, weights, total)
    asked: dict = {}
    for (p, _), n in min_cost_flow(supply, quotas).items():
        asked[p] = asked.get(p, 0) + n
    return sizes, quotas, {p: (supply[p], asked.get(p, 0)) for p in supply}


def _overlapping(sizes: dict, weights: dict, total: float) -> dict:
    """Targets when documents belong to several sources: the total counts each document once."""
    scale = total / max(1, sum(sizes.values()))
    bound = {s: n * scale for s, n in sizes.items()}
    return targets(bound, weights)


def cuts(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """pattern, limit, cut (draw, id) and took: how far the seeded order of each pattern's rows fits into its gap.

    rows: pattern, size, draw, doc_id of the rows that may be taken, none larger than ``gap``. Block sums
    give the block in which the gap ends; only that block is ordered.
    """
    blocks = rows.withColumn("block", F.shiftright("draw", 51)).groupBy("pattern", "block").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("pattern").orderBy("block")  # at most 4096 blocks a pattern
    blocks = blocks.withColumn("start", F.sum("held").over(before) - F.col("held")).join(F.broadcast(gaps), "pattern")
    whole = blocks.where("start + held <= gap").groupBy("pattern").agg(F.max("block").alias("upto"), F.sum("held").alias("took"))
    last = blocks.where("start < gap AND start + held > gap").select("pattern", "block", "start", "gap")
    order = Window.partitionBy("pattern", "block").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = (rows.withColumn("block", F.shiftright("draw", 51)).join(F.broadcast(last), ["pattern", "block"])
            .withColumn("end", F.col("start") + F.sum("size").over(order)).where("end <= gap"))
    inside = ends.groupBy("pattern").agg(F.max(F.struct("draw", "doc_id")).alias("cut"), F.max("end").alias("end"))
    edge = F.struct(((F.col("upto") + 1) * F.lit(1 << 51) - 1).alias("draw"), F.lit(2**63 - 1).alias("doc_id"))
    return (gaps.join(whole, "pattern", "left").join(inside, "pattern", "left")
            .select("pattern", F.col("gap").alias("limit"), F.coalesce("cut", F.when(F.col("upto").isNotNull(), edge)).alias("cut"),
                    F.coalesce("end", "took", F.lit(0)).alias("took")).where("took > 0"))


def taken(rounds: Column) -> Column:
    """Whether a row (size, draw, doc_id) is taken by one of its pattern's rounds."""
    here = F.struct("draw", "doc_id")
    return F.exists(rounds, lambda r: (F.col("size") <= r["limit"]) & (here <= r["cut"]))


def mix_plan(slim: DataFrame, weight_of) -> DataFrame:
    """One row per pattern: whole repeats, and the rounds by which documents are taken once more.

    In a round the documents that still fit into what is left, in the seeded order, are taken as far
    as they fit. What stops a round is larger than the rest, so it is no candidate of the next one.
    When no document fits, the smallest one left is taken if that comes nearer: a pattern misses its
    tokens by at most half of that document.
    """
    spark = slim.sparkSession
    sizes, quotas, plan = plan_mix(slim, weight_of)
    table, left, rounds = [], {}, {}
    for p, (supply, asked) in plan.items():
        whole = asked // supply if supply else 0
        one = p[0] if p else None
        table.append((list(p), whole, sizes.get(one), quotas.get(one, 0.0)))
        left[p], rounds[p] = asked - whole * supply, []
    cut_type = "array<struct<limit:bigint,cut:struct<draw:bigint,doc_id:bigint>>>"

    def open_rows(patterns):
        """Gaps, one row a pattern, as many as the plan has, and the rows that no round has taken."""
        gaps = spark.createDataFrame([(list(p), left[p], rounds[p]) for p in patterns], f"pattern array<string>, gap long, rounds {cut_type}")
        return gaps, slim.join(F.broadcast(gaps), "pattern").where((F.col("size") > 0) & ~taken(F.col("rounds")))

    open_ = {p for p, n in left.items() if n > 0}
    while open_:
        gaps, rows = open_rows(open_)
        rows = rows.where(F.col("size") <= F.col("gap"))
        found = cuts(rows.select("pattern", "size", "draw", "doc_id"), gaps.select("pattern", "gap")).collect()
        open_ = set()
        for r in found:
            p = tuple(r["pattern"])
            rounds[p].append((r["limit"], (r["cut"]["draw"], r["cut"]["doc_id"])))
            left[p] -= r["took"]
            if left[p] > 0:
                open_.add(p)
    if short := [p for p, n in left.items() if n > 0]:
        _, rows = open_rows(short)
        least = rows.groupBy("pattern", "gap").agg(F.min(F.struct("size", "draw", "doc_id")).alias("one")).where("one.size < 2 * gap")
        for r in least.collect():
            rounds[tuple(r["pattern"])].append((r["one"]["size"], (r["one"]["draw"], r["one"]["doc_id"])))
    rows = [(*r, rounds[tuple(r[0])]) for r in table]
    return spark.createDataFrame(rows, f"pattern array<string>, whole long, source_size long, target double, rounds {cut_type}")


def with_copies(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", seed: int = 7,
                weight_of=lambda i: i % 3 + 1) -> tuple[DataFrame, DataFrame]:
    """(rows, slim): ``slim`` has doc_id, pattern, size, source_size, target and copies (0 to 3)
    for every document; ``rows`` has the documents themselves with ``copies``.

    members: an array of source names (null allowed). Every document of a pattern gets the whole
    repeats; the rest of the pattern's tokens goes to documents in the order of a seeded hash of
    the id, those that still fit, in rounds (``mix_plan``). Documents of size 0 get only
    whole repeats. Rows of one id are taken together. An empty table gives empty results.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[id_col].cast("long")), 1)
    key = F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1))
    pattern = F.array_sort(members)
    slim = stage(docs.select(docs[id_col].cast("long").alias("id"), key.alias("doc_id"), pattern.alias("pattern"),
                             size.alias("size"), draw.alias("draw")), "mix-sizes")
    plan = mix_plan(slim, weight_of)

    def applied(df: DataFrame) -> DataFrame:
        extra = (F.col("size") > 0) & taken(F.col("rounds"))
        return df.join(F.broadcast(plan), "pattern").withColumn("copies", F.col("whole") + extra.cast("long")).drop("rounds")

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("doc_id"), pattern.alias("pattern"),
                       size.alias("size"), draw.alias("draw"))
    return applied(rows), applied(slim)


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """``with_copies`` for documents of one source each: size is the number of words, null counts as 0."""
    return with_copies(docs, F.array(docs[source_col].cast("string")), word_count(docs[text_col]), id_col)


def mixed(docs: DataFrame, **columns) -> DataFrame:
    """The documents the mix takes, each row repeated as often as it is taken, with their own columns."""
    rows, _ = mix_by_source(docs, **columns)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("time")
    return rows.where("copies > 0").select("row", times).select("row.*")
