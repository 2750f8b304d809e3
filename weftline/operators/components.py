"""Strongly connected components, reachability and cleaning of edge tables (from_state, to_state) of any size.

Components are found by forward and backward passes from all states at once. A pass gives each state the largest state
that reaches it (or that it reaches), in rounds of one join with the edges and one with itself: what reaches the largest
state known so far reaches this one, too, so that paths double with every round. States on a common cycle share both
values; those whose two values are equal are a whole component, for the largest state of a class has its component as
the states that reach it. Components found leave, edges between different values leave (no cycle has one), states
without an edge in or out are trimmed, and what is left goes round again. Every round is a kept table. Once at most
local_edges edges are left, the rest is done on the driver.

States are numbers; edges may be repeated, edges with a null end are ignored, loops don't matter. A state without edges
is a component of its own if states lists it. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import kept

from .graphs import parts_of

#: Edges that the driver takes when no more are left: two numbers each.
LOCAL_EDGES = 1 << 17


def _dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled: a broadcast in every round would send the tables through the driver."""
    return df.hint("merge")


def _plain(edges: DataFrame) -> DataFrame:
    rows = edges.select(F.col("from_state").cast("long").alias("a"), F.col("to_state").cast("long").alias("b"))
    return rows.where("a is not null and b is not null and a <> b").distinct()


def largest_source(edges: DataFrame) -> DataFrame:
    """(state, top): for each state of edges (a, b) the largest state that reaches it, itself included."""
    top = edges.select(F.explode(F.array("a", "b")).alias("state")).distinct().select("state", F.col("state").alias("top"))
    top = kept(top, "components")
    while True:
        told = edges.join(_dealt(top.select(F.col("state").alias("a"), "top")), "a").groupBy(F.col("b").alias("state")).agg(F.max("top").alias("told"))
        after = top.join(_dealt(told), "state", "left").select("state", "top", F.greatest("top", F.coalesce("told", "top")).alias("new"))
        after = kept(after, "components")
        if after.where("new > top").isEmpty():
            return top
        # The top of the top reaches the state as well.
        further = after.select(F.col("state").alias("new"), F.col("new").alias("far"))
        top = kept(after.join(_dealt(further), "new").select("state", F.greatest("new", "far").alias("top")), "components")


def trimmed(edges: DataFrame, least: float = 0.05) -> tuple[DataFrame, int]:
    """edges (a, b) without those of states that nothing enters or leaves, and their number; rounds go on while one takes at
    least the share least of the edges, which is cheaper than passes over these edges."""
    n = edges.count()
    while n:
        left, entered = edges.select("a").distinct(), edges.select(F.col("b").alias("a")).distinct()
        live = _dealt(left.join(_dealt(entered), "a", "left_semi"))
        edges = kept(edges.join(live, "a", "left_semi").join(_dealt(live.withColumnRenamed("a", "b")), "b", "left_semi").select("a", "b"), "components")
        before, n = n, edges.count()
        if before - n <= least * before:
            break
    return edges, n


def components(edges: DataFrame, states: DataFrame | None = None, directed: bool = True, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(state, component, size): each state with the smallest state of its component and the component's size.

    With directed=False edges count both ways. states (state): further states, which may be without edges.
    """
    spark = edges.sparkSession
    own = kept(_plain(edges), "components")
    every = own.select(F.explode(F.array("a", "b")).alias("state"))
    if states is not None:
        every = every.unionByName(states.select(F.col("state").cast("long").alias("state")).where("state is not null"))
    left = own if directed else kept(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components")
    found = []
    while True:
        left, n = trimmed(left)
        if n <= local_edges:
            break
        fore = largest_source(left).withColumnRenamed("top", "fore")
        back = largest_source(_within(left, fore, "fore").select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("top", "back")
        both = kept(fore.join(_dealt(back), "state", "left").select("state", "fore", F.coalesce("back", "state").alias("back")), "components")
        found.append(both.where("fore = back").select("state", F.col("fore").alias("mark")))
        rest = both.where("fore <> back")
        left = kept(_within(_within(left, rest, "fore"), rest, "back"), "components")
    if n:
        ends: dict[int, list[int]] = {}
        for a, b in left.collect():  # at most local_edges
            ends.setdefault(a, []).append(b)
        rows = [(s, max(part)) for part in parts_of(ends) if len(part) > 1 for s in part]
        if rows:
            found.append(spark.createDataFrame(rows, "state long, mark long"))
    marks = every.distinct().select("state", F.col("state").alias("mark"), F.lit(True).alias("alone"))
    for f in found:
        marks = marks.unionByName(f.withColumn("alone", F.lit(False)))
    marks = kept(marks.groupBy("state").agg(F.min_by("mark", "alone").alias("mark")), "components")
    named = marks.groupBy("mark").agg(F.min("state").alias("component"), F.count("*").alias("size"))
    return marks.join(_dealt(named), "mark").select("state", "component", "size")


def _within(edges: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """edges whose two ends have the same value in values (state, name)."""
    a = values.select(F.col("state").alias("a"), F.col(name).alias("_va"))
    b = values.select(F.col("state").alias("b"), F.col(name).alias("_vb"))
    return edges.join(_dealt(a), "a").join(_dealt(b), "b").where("_va = _vb").select("a", "b")


def reached(edges: DataFrame, sources: DataFrame, directed: bool = True, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, state): every state that each of sources (state) reaches, itself included.

    The search runs over components, so its rounds are the length of the longest way between components, not states.
    """
    sources = sources.select(F.col("state").cast("long").alias("state")).where("state is not null").distinct()
    parts = kept(components(edges, sources, directed, local_edges).select("state", "component"), "components")
    a, b = (parts.select(F.col("state").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    own = _plain(edges)
    if not directed:
        own = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
    steps = kept(own.join(_dealt(a), "a").join(_dealt(b), "b").where("ca <> cb").select("ca", "cb").distinct(), "components")
    seen = sources.join(_dealt(parts), "state").select(F.col("component").alias("source"), F.col("component").alias("at")).distinct()
    front = seen = kept(seen, "components")
    while True:
        more = front.join(_dealt(steps), front["at"] == F.col("ca")).select("source", F.col("cb").alias("at")).distinct()
        front = kept(more.join(_dealt(seen), ["source", "at"], "left_anti"), "components")
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front), "components")
    ends = seen.join(_dealt(parts.select("state", F.col("component").alias("at"))), "at").select(F.col("source").alias("component"), "state")
    return sources.withColumnRenamed("state", "source").join(_dealt(parts.withColumnRenamed("state", "source")), "source").join(_dealt(ends), "component").select("source", "state")


def reach_counts(edges: DataFrame, sources: DataFrame, directed: bool = True, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, n, last): how many states each of sources (state) reaches, itself included, and the largest of them.

    Every island (what hangs together, whichever way the edges go) has a hub, its largest component. What the hubs reach
    and what reaches them is searched once. A source that reaches its island's hub counts the hub's states as one number
    and searches only outside them; other sources never meet the hub. So pairs of sources and states are made only beside
    the hubs, and the counts are exact.
    """
    sources = sources.select(F.col("state").cast("long").alias("state")).where("state is not null").distinct()
    parts = kept(components(edges, sources, directed, local_edges).select("state", "component"), "components")
    sums = kept(parts.groupBy("component").agg(F.count("*").alias("size"), F.max("state").alias("last")), "components")
    a, b = (parts.select(F.col("state").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    own = _plain(edges)
    steps = own.join(_dealt(a), "a").join(_dealt(b), "b").where("ca <> cb").select("ca", "cb").distinct()
    # With directed=False the components are the islands, and there are no steps between them.
    steps = kept(steps if directed else steps.limit(0), "components")
    back = steps.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))
    island = largest_source(steps.unionByName(back).select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("state", "component")
    placed = sums.join(_dealt(island), "component")
    hubs = kept(placed.groupBy("top").agg(F.max_by("component", F.struct("size", "component")).alias("hub")).select("hub"), "components")

    ways = steps.withColumn("up", F.lit(False)).unionByName(back.withColumn("up", F.lit(True)))
    start = hubs.select("hub", F.col("hub").alias("at"), F.explode(F.array(F.lit(False), F.lit(True))).alias("up"))
    near = kept(_searched(start, ways, ["at", "up"]), "components")
    whole = near.where("not up").join(_dealt(sums.withColumnRenamed("component", "at")), "at").groupBy("hub").agg(F.sum("size").alias("n"), F.max("last").alias("last"))
    above = near.where("up").select(F.col("at").alias("component"), "hub")
    below = near.where("not up").select(F.col("at").alias("cb"), F.lit(True).alias("below"))

    # up: whether the source reaches the hub; then steps to what the hub reaches lead to nothing new.
    ways = steps.join(_dealt(below), "cb", "left").select("ca", "cb", F.col("below").isNull().alias("beside"))
    ways = ways.select("ca", "cb", F.explode(F.when(F.col("beside"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("up"))
    begun = kept(sources.join(_dealt(parts), "state").select("component").distinct().join(_dealt(above), "component", "left"), "components")
    start = begun.select(F.col("component").alias("source"), F.col("component").alias("at"), F.col("hub").isNotNull().alias("up"))
    inside = below.select(F.col("cb").alias("at"))
    found = _searched(start.join(_dealt(inside), "at", "left_anti").unionByName(start.where("not up").join(_dealt(inside), "at", "left_semi")), kept(ways, "components"), ["source", "at"])
    beside = found.select("source", "at").join(_dealt(sums.withColumnRenamed("component", "at")), "at").select("source", F.col("size").alias("n"), "last")
    through = begun.where("hub is not null").join(_dealt(whole), "hub").select(F.col("component").alias("source"), "n", "last")
    counts = beside.unionByName(through).groupBy(F.col("source").alias("component")).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    named = parts.withColumnRenamed("state", "source").join(_dealt(sources.withColumnRenamed("state", "source")), "source", "left_semi")
    return named.join(_dealt(counts), "component").select("source", "n", "last")


def _searched(start: DataFrame, ways: DataFrame, key: list[str]) -> DataFrame:
    """The rows of start (at, up, ...) and of all that they reach by ways (ca, cb, up), once for each key; other columns are handed on."""
    front = seen = kept(start, "components")
    while True:
        other = [c for c in start.columns if c not in ("at", "up")]
        more = front.join(_dealt(ways.withColumnsRenamed({"ca": "at"})), ["at", "up"]).select(*[F.col("cb").alias("at") if c == "at" else F.col(c) for c in ["at", "up", *other]])
        front = kept(more.distinct().join(_dealt(seen), key, "left_anti").select(*start.columns), "components")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)  # each front is a table of its own


def connected(edges: DataFrame, sources: DataFrame, ends: DataFrame, directed: bool = True, local_edges: int = LOCAL_EDGES) -> bool:
    """Whether every one of ends (state) is reached from every one of sources (state)."""
    goals = ends.select(F.col("state").cast("long").alias("state")).distinct()
    n = goals.count()
    hits = reached(edges, sources, directed, local_edges).join(goals, "state").groupBy("source").count().where(F.col("count") == n)
    return n == 0 or hits.count() == sources.where("state is not null").select("state").distinct().count()


def cleaned_edges(edges: DataFrame, weight: str = "p") -> DataFrame:
    """(from_state, to_state, p): the chain without states that are never entered or never left, in rows that sum to one.

    States go from the last to the first, as in markov.cleaned: one is judged by the states not gone by then, so the
    loss of a smaller state does not count against a larger one. Each round takes all states whose last support has
    just gone; self-transitions support nothing.
    """
    rows = kept(edges.where(F.col(weight) > 0).groupBy("from_state", "to_state").agg(F.sum(weight).alias("p")), "components")
    every = rows.select(F.explode(F.array("from_state", "to_state")).alias("state")).distinct()
    other = rows.where("from_state <> to_state")
    # A state rests on an edge in and an edge out; needs says which, by is the state at its other end.
    rests = other.select(F.col("to_state").alias("state"), F.col("from_state").alias("by"), F.lit("in").alias("needs"))
    rests = kept(rests.unionByName(other.select(F.col("from_state").alias("state"), F.col("to_state").alias("by"), F.lit("out").alias("needs"))), "components")
    stay = kept(every, "components")
    while True:
        held = rests.groupBy("state").agg(F.count_distinct("needs").alias("n")).where("n = 2")
        now = kept(stay.join(_dealt(held), "state", "left_semi"), "components")
        lost = kept(stay.join(_dealt(now), "state", "left_anti"), "components")
        stay = now
        if lost.isEmpty():
            break
        gone = lost.withColumnRenamed("state", "by").withColumn("gone", F.lit(True))
        rests = rests.join(_dealt(gone), "by", "left").where(F.col("gone").isNull() | (F.col("by") < F.col("state"))).drop("gone")
        rests = kept(rests.join(_dealt(stay), "state", "left_semi"), "components")
    a, b = stay.withColumnRenamed("state", "from_state"), stay.withColumnRenamed("state", "to_state")
    rows = rows.join(_dealt(a), "from_state", "left_semi").join(_dealt(b), "to_state", "left_semi")
    return rows.select("from_state", "to_state", (F.col("p") / F.sum("p").over(Window.partitionBy("from_state"))).alias("p"))
