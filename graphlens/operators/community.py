"""Communities and ranks by repeated joins and aggregates."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, materialize
from graphlens.graph import Graph
from graphlens.operators.structure import union


def class_links(graph: Graph) -> DataFrame:
    """(a, b, w): undirected CALLS and DEPENDS_ON links between classes, both directions listed."""
    classes = graph.of_kind("CLASS").select("fqn")
    links = graph.edges_of("CALLS", "DEPENDS_ON").filter("src IS NOT NULL AND dst IS NOT NULL")
    links = links.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("w"))
    for end in ("a", "b"):
        links = links.join(classes.withColumnRenamed("fqn", end), end, "left_semi")
    return _mirrored(links.select("a", "b", F.expr("CASE WHEN a = b THEN 2 * w ELSE w END").alias("w")))


def _mirrored(links: DataFrame) -> DataFrame:
    """``links(a, b, w)`` and the same from b to a; loops stay single. No link is shuffled for it."""
    both = F.expr("CASE WHEN a = b THEN array(struct(a, b, w)) ELSE array(struct(a, b, w), struct(b AS a, a AS b, w)) END")
    return links.select(F.explode(both).alias("link")).select("link.*")


def modularity(links: DataFrame, members: DataFrame) -> float:
    """Modularity of ``members(node, community)`` on symmetric ``links(a, b, w)``; 0 without links."""
    side = links.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a")
    both = side.join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    per = both.groupBy("ca").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = per.agg(F.sum("total").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares")).first()
    if not row["m2"]:
        return 0.0
    return row["inside"] / row["m2"] - row["squares"] / (row["m2"] * row["m2"])


def louvain(graph: Graph, tolerance: float = 1e-6) -> DataFrame:
    """(fqn, community): communities of the classes by modularity gain, named by their smallest class.

    A sweep lets open nodes look at the communities of their neighbours and move
    to the best gain, ties to the smallest name. Nodes with a single neighbour
    belong to it in some best division, so they follow it before the first sweep
    and a star is one node from the start. Moves of one sweep are
    simultaneous, so only nodes of one hash half may move: two neighbours rarely
    swap places. Every node is open at first, afterwards only those next to one
    that moved, so a sweep reads the links of what may still change; the gain of
    its moves is summed over the links of the movers. When two sweeps in a row gain
    nothing, communities become the nodes of the next level, until a level gains
    nothing. At last every community is split into its connected parts, which
    never lowers modularity; followers are connected to whom they follow, so only
    the others are looked at there and on the levels. Only scalars reach the driver.
    """
    classes = graph.of_kind("CLASS").select(F.col("fqn").alias("node")).distinct()
    links = materialize(class_links(graph), "links")
    m2 = links.agg(F.sum("w")).first()[0]
    followed = materialize(_followed(links), "followed")
    homes = materialize(
        classes.join(followed, "node", "left").select("node", F.coalesce("community", "node").alias("home")), "homes"
    )
    first = level_links = _coarse(links, followed)
    mapping = materialize(homes.select(F.col("home").alias("node")).distinct().withColumn("community", F.col("node")), "level")
    # Without a link between two nodes of a level nothing can gain.
    while m2 and not level_links.filter("a <> b").isEmpty():
        placed, gained = _level(level_links, m2, tolerance)
        if gained <= tolerance:
            break
        lifted = mapping.join(placed.select(F.col("node").alias("community"), F.col("community").alias("next")), "community", "left")
        mapping = materialize(lifted.select("node", F.coalesce("next", "community").alias("community")), "level")
        level_links = _coarse(level_links, placed)
    parts = connected_communities(first, mapping).select(F.col("node").alias("home"), F.col("community").alias("part"))
    members = materialize(homes.join(parts, "home").select("node", "part"), "members")
    named = members.groupBy("part").agg(F.min("node").alias("community"))
    return members.join(named, "part").select(F.col("node").alias("fqn"), "community")


def _followed(links: DataFrame) -> DataFrame:
    """(node, community) of all linked nodes: one with a single neighbour and no loop goes with it, a pair of such with the smaller."""
    other = F.when(F.col("a") != F.col("b"), F.col("b"))
    ends = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min(other).alias("only"))
    ends = materialize(ends.select("node", "only", F.expr("n = 1 AND only IS NOT NULL").alias("leaf")), "ends")
    leaves = ends.filter("leaf").select("node", "only")
    paired = leaves.join(ends.filter("leaf").select(F.col("node").alias("only"), F.lit(True).alias("paired")), "only", "left")
    home = F.when(F.col("paired"), F.least("node", "only")).otherwise(F.col("only"))
    return paired.select("node", home.alias("community")).unionByName(ends.filter("NOT leaf").select("node", F.col("node").alias("community")))


def _coarse(links: DataFrame, placed: DataFrame) -> DataFrame:
    """Links between the communities of ``placed(node, community)``; a link is followed from one of its ends."""
    coarse = links.filter("a <= b").join(placed.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(
        placed.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b"
    )
    weight = F.expr("CASE WHEN a <> b AND ca = cb THEN 2 * w ELSE w END")
    folded = coarse.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum(weight).alias("w"))
    return materialize(_mirrored(folded), "links")


def _level(links: DataFrame, m2: float, tolerance: float) -> tuple[DataFrame, float]:
    """(node, community) after local moves and the modularity they gained."""
    degrees = materialize(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree")), "degree")
    placed = degrees.select("node", F.col("node").alias("community"))
    totals = degrees.select(F.col("node").alias("community"), F.col("degree").alias("total"))
    active, gained, idle = degrees.select("node"), 0.0, 0
    for sweep in count():
        # Another split in halves every two sweeps, so that neighbours do not stay in step.
        turn = F.pmod(F.xxhash64("node", F.lit(sweep // 2)), F.lit(2)) == sweep % 2
        moves = materialize(_moves(links, placed, degrees, totals, active.filter(turn), m2), "moves")
        gain = _gain(links, placed, degrees, totals, moves, m2)
        waiting = active.filter(~turn)
        if gain <= tolerance:
            idle += 1
            if idle == 2:  # neither half of the nodes gains anything
                return placed, gained
            continue
        idle, gained = 0, gained + gain
        placed = placed.join(moves.select("node", F.col("community").alias("_to")), "node", "left")
        placed = materialize(placed.select("node", F.coalesce("_to", "community").alias("community")), "placed")
        totals = materialize(placed.join(degrees, "node").groupBy("community").agg(F.sum("degree").alias("total")), "totals")
        near = links.join(moves.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
        active = materialize(waiting.unionByName(near).distinct(), "active")


def _moves(links: DataFrame, placed: DataFrame, degrees: DataFrame, totals: DataFrame, active: DataFrame, m2: float) -> DataFrame:
    """(node, home, community, degree) of the active nodes that are better off elsewhere."""
    mine = placed.join(active, "node", "left_semi").join(degrees, "node")
    near = (
        links.filter("a <> b").join(active.withColumnRenamed("node", "a"), "a", "left_semi").join(placed.withColumnRenamed("node", "b"), "b")
        .groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("shared"))
    )
    own = mine.select("node", "community").withColumn("shared", F.lit(0.0))
    options = near.unionByName(own).groupBy("node", "community").agg(F.sum("shared").alias("shared"))
    scored = (
        options.join(mine.select("node", "degree", F.col("community").alias("home")), "node").join(totals, "community")
        .withColumn("stays", F.when(F.col("community") == F.col("home"), 0).otherwise(1))
        .withColumn("rest", F.col("total") - F.when(F.col("stays") == 0, F.col("degree")).otherwise(0.0))
        .withColumn("loss", F.round(-(F.col("shared") - F.col("degree") * F.col("rest") / F.lit(m2)), 9))
    )
    best = first_by(scored, ["node"], ["loss", "stays", "community"], ["community", "home", "degree"])
    return best.filter("community <> home")


def _gain(links: DataFrame, placed: DataFrame, degrees: DataFrame, totals: DataFrame, moves: DataFrame, m2: float) -> float:
    """Change of modularity by ``moves``, from the links of the movers and the communities they leave and enter."""
    other = placed.join(moves.select("node", F.col("community").alias("_to")), "node", "left").select(
        F.col("node").alias("b"), F.col("community").alias("old"), F.coalesce("_to", "community").alias("new"), F.col("_to").isNull().alias("still")
    )
    touched = links.join(moves.select(F.col("node").alias("a"), "home", F.col("community").alias("to")), "a").join(other, "b")
    # A link to a node that stays is listed from both ends, but only the mover's end is read here.
    sides = F.when(F.col("still"), 2.0).otherwise(1.0)
    change = (F.col("to") == F.col("new")).cast("double") - (F.col("home") == F.col("old")).cast("double")
    inside = touched.agg(F.sum(sides * F.col("w") * change)).first()[0]
    if inside is None:
        return 0.0
    leave = moves.select(F.col("home").alias("community"), (-F.col("degree")).alias("delta"))
    enter = moves.select("community", F.col("degree").alias("delta"))
    deltas = leave.unionByName(enter).groupBy("community").agg(F.sum("delta").alias("delta")).join(totals, "community")
    squares = deltas.agg(F.sum(F.col("delta") * (2 * F.col("total") + F.col("delta")))).first()[0]
    return inside / m2 - squares / (m2 * m2)


def connected_communities(links: DataFrame, members: DataFrame) -> DataFrame:
    """``members(node, community)`` with every community cut into its connected parts, named by their smallest node.

    Labels travel along links inside a community and are looked up at their own
    label as well, so a long path needs about log2(length) rounds.
    """
    inner = links.filter("a <> b").join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(
        members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b"
    )
    inner = materialize(inner.filter("ca = cb").select("a", "b"), "inner")
    labels = materialize(members.select("node", F.col("node").alias("community")), "labels")
    while True:
        offered = inner.join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node")).agg(F.min("community").alias("seen"))
        lowest = labels.join(offered, "node", "left").select("node", "community", F.least("community", "seen").alias("low"))
        # The best label offered to any node is an offer to the label that the node wears now.
        root = lowest.groupBy(F.col("community").alias("node")).agg(F.min("low").alias("hung"))
        hooked = materialize(lowest.join(root, "node", "left").select("node", "community", F.least("low", "hung").alias("low")), "hooked")
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("further"))
        fresh = materialize(hooked.join(jump, "low").select("node", F.least("low", "further").alias("now"), "community"), "labels")
        done = fresh.filter("now < community").isEmpty()
        labels = fresh.select("node", F.col("now").alias("community"))
        if done:
            return labels


def community_summary(graph: Graph, members: DataFrame) -> DataFrame:
    """One row: number of communities and their modularity."""
    score = modularity(materialize(class_links(graph), "links"), members.withColumnRenamed("fqn", "node"))
    return members.agg(F.count_distinct("community").alias("communities")).withColumn("modularity", F.lit(score))


def pagerank(graph: Graph, kinds: list[str], iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(fqn, pagerank) over distinct edges of ``kinds``; dangling rank is spread evenly.

    Ranks sum to 1. What differs between iterations is one number, the rank that all nodes get alike; the rest are sums over walks:
    a round finds how much of one unit on every node arrives after one more edge, and ranks are these rounds weighted by those
    numbers. A round is one join on the source and one aggregate with a map-side combine on the target; where all walks end,
    there are no more rounds.
    """
    nodes = materialize(graph.nodes.select("fqn").distinct(), "rank_nodes")
    edges = graph.edges_of(*kinds).select("src", "dst")
    for end in ("dst", "src"):
        edges = edges.join(nodes.withColumnRenamed("fqn", end), end, "left_semi")
    # Partitioned by source already, so this takes no shuffle of its own.
    edges = materialize(edges.select("src", "dst").distinct(), "rank_edges")
    degree = materialize(edges.groupBy("src").agg(F.count("*").alias("degree")), "degree")
    total = nodes.count()
    if total == 0:
        return nodes.withColumn("pagerank", F.lit(0.0))
    arrived = [nodes.withColumn("amount", F.lit(1.0))]
    stuck: list[float] = []  # what arrives at nodes without a way out, by round
    while True:
        sent = arrived[-1].withColumnRenamed("fqn", "src").join(degree, "src", "left")
        stuck.append(sent.filter("degree IS NULL").agg(F.coalesce(F.sum("amount"), F.lit(0.0))).first()[0])
        if len(arrived) > iterations:
            break
        passed = sent.filter("degree IS NOT NULL").select("src", (F.col("amount") / F.col("degree")).alias("amount"))
        layer = materialize(edges.join(passed, "src").groupBy(F.col("dst").alias("fqn")).agg(F.sum("amount").alias("amount")), "arrived")
        if layer.isEmpty():
            break
        arrived.append(layer)
    given = [1.0 / total]  # what every node gets, the latest iteration first
    for _ in range(iterations):
        dangling = sum(g * damping**k * x for k, (g, x) in enumerate(zip(given, stuck)))
        given.insert(0, (1.0 - damping) / total + damping * dangling / total)
    ranks = [layer.select("fqn", (F.col("amount") * F.lit(g * damping**k)).alias("amount")) for k, (g, layer) in enumerate(zip(given, arrived))]
    return materialize(union(ranks).groupBy("fqn").agg(F.sum("amount").alias("pagerank")), "ranks")


def pagerank_within(graph: Graph, kinds: list[str], bound: float = 1e-6, damping: float = 0.85) -> DataFrame:
    """(fqn, pagerank) whose absolute errors sum to at most ``bound``; the model of :func:`pagerank`, carried to its limit.

    Nodes hold a residual, the rank that has not been passed on. A round passes on
    the residuals above a floor and leaves the rest where it is, so finished parts
    of the graph are not read again. What is left over, times 1 / (1 - damping),
    bounds the error, and the floor is the share of a node in the error allowed.
    Spreading the rank of dangling nodes evenly only scales the solution, so it is
    done once at the end.
    """
    nodes = materialize(graph.nodes.select("fqn").distinct(), "rank_nodes")
    total = nodes.count()
    if total == 0:
        return nodes.withColumn("pagerank", F.lit(0.0))
    edges = graph.edges_of(*kinds).select("src", "dst").distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes.withColumnRenamed("fqn", end), end, "left_semi")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    shares = materialize(edges.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("share")), "shares")
    # Unscaled ranks sum to at least 1 - damping; scaling to 1 doubles a relative error at most.
    floor = bound * (1.0 - damping) ** 2 / 2 / total
    residual = nodes.withColumn("amount", F.lit((1.0 - damping) / total))
    passed: list[DataFrame] = []
    while True:
        residual = materialize(residual, "residual")
        pushed = residual.filter(F.col("amount") > floor)
        if pushed.isEmpty():
            break
        passed.append(pushed)
        if len(passed) == 16:
            passed = [materialize(union(passed).groupBy("fqn").agg(F.sum("amount").alias("amount")), "passed")]
        inflow = shares.join(pushed.select(F.col("fqn").alias("src"), "amount"), "src").select(
            F.col("dst").alias("fqn"), (F.col("share") * F.col("amount")).alias("amount")
        )
        residual = residual.filter(F.col("amount") <= floor).unionByName(inflow).groupBy("fqn").agg(F.sum("amount").alias("amount"))
    # The rest is rank as well, only not passed on.
    ranks = materialize(union([*passed, residual]).groupBy("fqn").agg(F.sum("amount").alias("amount")), "ranks")
    scale = ranks.agg(F.sum("amount")).first()[0]
    return ranks.select("fqn", (F.col("amount") / F.lit(scale)).alias("pagerank"))
