"""Session graphs: components, closures, orders, ancestors, lineages.

Every iteration is a handful of DataFrame joins over the edges that are still of interest; each
round ends in a table in the shared folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convhist.functions.ids import multiset_digest
from convhist.operators.skew import lookup_join
from convhist.session import materialize


def _with_nearest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours. Minima combine map-side; a hub's edges are split by AQE."""
    near = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(near, "u")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step of the two-phase star contraction."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    small = _with_nearest(materialize(large.distinct()))
    links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v")))
    return links.distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: nothing is left to contract."""
    ends = edges.select(F.col("u").alias("_x"), F.lit(1).alias("_u"), F.lit(0).alias("_v")).union(edges.select("v", F.lit(0), F.lit(1)))
    state = ends.groupBy("_x").agg(F.sum("_u").alias("_u"), F.max("_v").alias("_v"))
    return state.filter("_u > 1 or (_u = 1 and _v = 1)").isEmpty()


def components(nodes: DataFrame, edges: DataFrame, node: str = "session_ref", src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected connected components: (node, component_ref = smallest member).

    Alternating star contraction: the edge set never grows, hubs stay stars (no pairs inside a
    group are made), and the number of rounds is logarithmic, also on long chains.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    )
    current = materialize(pairs)
    while not _all_stars(current):
        current = materialize(_stars(current))
    labels = current.select(F.col("u").alias(node), F.col("v").alias("_root"))
    return nodes.select(node).join(labels, node, "left").select(node, F.coalesce("_root", node).alias("component_ref"))


def component_members(labels: DataFrame, node: str = "session_ref") -> DataFrame:
    """Members as rows with the size of their component; rows rather than one unbounded list."""
    sizes = labels.groupBy("component_ref").agg(F.count(F.lit(1)).alias("members"))
    return lookup_join(labels, sizes, ["component_ref"], "inner", [node])


def invalid_components(nodes: DataFrame, edges: DataFrame, labels: DataFrame, node: str = "session_ref", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, invalid): an edge to an unknown node makes the whole component of its known end invalid."""
    known = nodes.select(node)
    ends = edges.select(F.col(src).alias(node), F.col(dst).alias("_far")).union(edges.select(F.col(dst).alias(node), F.col(src).alias("_far")))
    dangling = ends.join(known.withColumnRenamed(node, "_far"), "_far", "left_anti").join(known, node, "left_semi")
    bad = labels.join(dangling.select(node), node, "left_semi").select("component_ref").distinct().withColumn("_bad", F.lit(True))
    marked = lookup_join(labels, bad, ["component_ref"], "left", [node])
    return marked.select(node, "component_ref", F.col("_bad").isNotNull().alias("invalid"))


def children(edges: DataFrame) -> DataFrame:
    """Direct children as rows (parent_ref, session_ref), each once; sort by both to list them."""
    return edges.select("parent_ref", "session_ref").distinct()


def chain_ends(steps: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Follow steps (node, up, w), one per node, to the first node without a step.

    Returns (node, up = end, w = total), the nodes that never get there as (node, up = a node of their cycle), and the
    jump tables (node, up) of the rounds. Pointer doubling; a row is written again only while its chain goes on.
    """
    open_, done = materialize(steps.select("node", "up", "w")), None
    left, jumps = _rounds(open_), []
    jumps.append(open_)
    while left > 0 and not open_.isEmpty():
        left -= 1
        hop = open_.select("node", "up", "w", F.lit(False).alias("_end"))
        if done is not None:
            hop = hop.unionByName(done.withColumn("_end", F.lit(True)))
        hop = hop.select(F.col("node").alias("up"), F.lit(True).alias("_on"), F.col("up").alias("_far"), F.col("w").alias("_more"), "_end")
        moved = materialize(
            open_.join(hop, "up", "left").select(
                "node", F.when(F.col("_on"), F.col("_far")).otherwise(F.col("up")).alias("up"),
                (F.col("w") + F.coalesce("_more", F.lit(0))).alias("w"), F.coalesce("_end", F.lit(True)).alias("_end"),
            )
        )
        jumps.append(moved.select("node", "up"))
        ended = moved.filter("_end").drop("_end")
        done = ended if done is None else done.unionByName(ended)
        open_ = moved.filter("NOT _end").drop("_end")
    return (steps.limit(0) if done is None else done), open_.select("node", "up"), jumps


def _shortcuts(links: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(chain ends, links out of the other nodes, jump tables) of the nodes with a single successor.

    A cycle of such nodes is opened at its smallest member, which then counts as one of the others.
    """
    single = links.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("up").alias("up")).filter("_n = 1")
    steps = materialize(single.select("node", "up", F.lit(1).cast("bigint").alias("w")))
    ends, stuck, jumps = chain_ends(steps)
    if not stuck.isEmpty():
        ring = materialize(stuck.select(F.col("up").alias("node")).distinct())
        labels = components(ring, steps.join(ring, "node", "left_semi"), "node", "node", "up")
        steps = materialize(steps.join(labels.select(F.col("component_ref").alias("node")).distinct(), "node", "left_anti"))
        ends, _, jumps = chain_ends(steps)
    return ends, links.join(steps, "node", "left_anti"), jumps


#: Rounds of a search along the links themselves before long chains are shortcut.
PLAIN_ROUNDS = 4


def _reach(start: DataFrame, links: DataFrame) -> DataFrame:
    """All nodes that links (node, up) lead to from the start nodes, which are included. Found nodes are only appended.

    A shallow search ends within PLAIN_ROUNDS. Beyond, a round goes from a node to the end of its chain of single
    successors and then to what follows that end, so only branchings cost rounds; the nodes passed are added at last, from
    the jump tables of the chains.

    The result is one table: a semi or anti join with a union would be done for each of its parts, all in one task.
    """
    links = materialize(links)
    reached = frontier = materialize(start)
    for _ in range(PLAIN_ROUNDS):
        frontier = _fresh(links, frontier, reached)
        if frontier.isEmpty():
            return materialize(reached)
        reached = reached.unionByName(frontier)
    ends, forks, jumps = _shortcuts(links)
    ends, forks = ends.select("node", F.col("up").alias("_end")), materialize(forks)
    heads = frontier
    while not frontier.isEmpty():
        stops = frontier.join(ends, "node", "left").select(F.coalesce("_end", "node").alias("node")).distinct()
        frontier = _fresh(forks, stops, heads)
        heads = heads.unionByName(frontier)
    passed = heads
    for jump in jumps:
        passed = passed.unionByName(_fresh(jump, passed, passed))
    return materialize(reached.unionByName(materialize(passed).join(reached, "node", "left_anti")))


def _fresh(links: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes one link behind `nodes` that were not seen, stored."""
    found = links.join(nodes, "node", "left_semi").select(F.col("up").alias("node")).distinct()
    return materialize(found.join(seen, "node", "left_anti"))


def closure(selected: DataFrame, edges: DataFrame, nodes: DataFrame, node: str = "session_ref", src: str = "session_ref", dst: str = "parent_ref") -> tuple[DataFrame, DataFrame]:
    """Transitive dependencies of a selection, and the dependencies that do not exist.

    The result is a node set (never root/node pairs), so it cannot outgrow the node table; see :func:`_reach`.
    """
    links = edges.select(F.col(src).alias("node"), F.col(dst).alias("up")).distinct()
    reached = _reach(selected.select(F.col(node).alias("node")).distinct(), links).withColumnRenamed("node", node)
    known = nodes.select(node)
    return reached.join(known, node, "left_semi"), reached.join(known, node, "left_anti")


def topo_levels(nodes: DataFrame, edges: DataFrame, node: str = "session_ref", src: str = "session_ref", dst: str = "parent_ref") -> DataFrame:
    """(node, level): dependencies have smaller levels; null marks nodes on or behind a cycle.

    Contraction: a node with one dependency hangs on it, at distance 1, and chains of such nodes on their end, by pointer
    doubling; edges to hung nodes are moved to the end and keep the greatest distance per pair. All nodes without
    dependencies are one floor (null), so a round settles what peeling would, and whole chains beside. What hangs on a
    node gets its level from that node's in the end, in reverse.
    """
    known = nodes.select(F.col(node).alias("node"))
    links = edges.select(F.col(src).alias("node"), F.col(dst).alias("up")).distinct()
    links = materialize(links.join(known.withColumnRenamed("node", "up"), "up", "left_semi").join(known, "node", "left_semi").select("node", "up"))
    floor = materialize(known.join(links, "node", "left_anti"))
    marks = floor.select(F.col("node").alias("up"), F.lit(True).alias("_floor")).distinct()
    left = links.join(marks, "up", "left").select("node", F.when(F.col("_floor").isNull(), F.col("up")).alias("up"), F.lit(1).cast("bigint").alias("w"))
    left, hung = materialize(left.groupBy("node", "up").agg(F.max("w").alias("w"))), []
    while True:
        single = left.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.max("up").alias("up"), F.max("w").alias("w")).filter("_n = 1")
        steps = materialize(single.select("node", "up", "w"))
        if steps.isEmpty():
            break
        ends, stuck, _ = chain_ends(steps)
        hung.append((ends, stuck))
        moves = ends.select(F.col("node").alias("up"), F.lit(True).alias("_on"), F.col("up").alias("_end"), F.col("w").alias("_more"))
        rest = left.join(steps, "node", "left_anti").join(moves, "up", "left")
        rest = rest.select("node", F.when(F.col("_on"), F.col("_end")).otherwise(F.col("up")).alias("up"), (F.col("w") + F.coalesce("_more", F.lit(0))).alias("w"))
        left = materialize(rest.groupBy("node", "up").agg(F.max("w").alias("w")))
    unknown = F.lit(None).cast("bigint").alias("level")
    levels = floor.select("node", F.lit(0).cast("bigint").alias("level")).unionByName(left.select("node").distinct().select("node", unknown))
    for ends, stuck in reversed(hung):
        below = levels.select(F.col("node").alias("up"), "level")
        placed = ends.join(below, "up", "left").select("node", F.when(F.col("up").isNull(), F.col("w")).otherwise(F.col("level") + F.col("w")).alias("level"))
        levels = levels.unionByName(materialize(placed.unionByName(stuck.select("node", unknown))))
    return levels.withColumnRenamed("node", node)


def _rounds(rows: DataFrame) -> int:
    """Doubling rounds that suffice for any forest of this many nodes; more mean a cycle."""
    return max(rows.count(), 1).bit_length() + 1


def doubled_parents(parents: DataFrame, key: list[str], node: str, parent: str):
    """Yield ancestor tables at distances 1, 2, 4, ... as (key, node, up); ends when none is left."""
    jump = materialize(parents.filter(F.col(parent).isNotNull()).select(*key, F.col(node).alias("node"), F.col(parent).alias("up")))
    left = _rounds(jump)
    while not jump.isEmpty():
        if left == 0:
            raise ValueError("parent relation contains a cycle")
        left -= 1
        yield jump
        hop = jump.select(*key, F.col("node").alias("up"), F.col("up").alias("_far"))
        jump = materialize(lookup_join(jump, hop, [*key, "up"], "inner", ["node"]).select(*key, "node", F.col("_far").alias("up")))


def cyclic_nodes(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes on or behind a cycle of a single-parent relation, in a logarithmic number of rounds.

    A node that still has an ancestor after more steps than there are nodes can only be one of them.
    """
    jump = materialize(parents.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up")))
    for _ in range(_rounds(jump)):
        if jump.isEmpty():
            break
        hop = jump.select(F.col("node").alias("up"), F.col("up").alias("_far"))
        jump = materialize(lookup_join(jump, hop, ["up"], "inner", ["node"]).select("node", F.col("_far").alias("up")))
    return jump.select(F.col("node").alias(node)).distinct()


def forest_depth(parents: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """(key, node, root, depth) by pointer doubling: rounds are the logarithm of the depth."""
    state = parents.select(
        *key, F.col(node).alias("node"), F.coalesce(F.col(parent), F.col(node)).alias("up"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
    )
    state = materialize(state)
    for _ in range(_rounds(state) + 1):
        hop = state.select(*key, F.col("node").alias("up"), F.col("up").alias("_far"), F.col("hops").alias("_more"))
        moved = lookup_join(state, hop, [*key, "up"], "inner", ["node"])
        state = materialize(
            moved.select(*key, "node", F.col("_far").alias("up"), (F.col("hops") + F.col("_more")).alias("hops"), (F.col("_more") > 0).alias("_moved"))
        )
        settled = state.filter("_moved").isEmpty()
        state = state.drop("_moved")
        if settled:
            break
    else:
        raise ValueError("parent relation contains a cycle")
    return state.select(*key, "node", F.col("up").alias("root"), F.col("hops").alias("depth"))


def path_to_root(starts: DataFrame, parents: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """All nodes on the way from each start to its root, starts included: (key, node).

    With the ancestors at distance 2^k of the nodes marked so far, the marked stretch doubles in
    each round.
    """
    marked = materialize(starts.select(*key, F.col(node).alias("node")).distinct())
    for jump in doubled_parents(parents, key, node, parent):
        found = jump.join(marked, [*key, "node"], "left_semi").select(*key, F.col("up").alias("node")).distinct()
        marked = marked.unionByName(materialize(found.join(marked, [*key, "node"], "left_anti")))
    return marked


def nearest_marked_ancestor(parents: DataFrame, marked: DataFrame, key: list[str], node: str, parent: str) -> DataFrame:
    """(key, node, ancestor): closest proper ancestor that is marked, null if there is none.

    Pointer doubling that stops at marked nodes: a jump never passes one.
    """
    stops = marked.select(*key, F.col(node).alias("up"), F.lit(True).alias("_stop")).distinct()
    state = parents.select(*key, F.col(node).alias("node"), F.col(parent).alias("up"))
    state = materialize(state.join(stops, [*key, "up"], "left").withColumn("_stop", F.coalesce("_stop", F.lit(False))))
    left = _rounds(state)
    while True:
        open_rows = state.filter("NOT _stop AND up IS NOT NULL")
        if open_rows.isEmpty():
            break
        if left == 0:
            raise ValueError("parent relation contains a cycle")
        left -= 1
        hop = state.select(*key, F.col("node").alias("up"), F.col("up").alias("_far"), F.col("_stop").alias("_s"))
        moved = lookup_join(open_rows, hop, [*key, "up"], "left", ["node"]).select(
            *key, F.col("_far").alias("up"), "node", F.coalesce("_s", F.lit(False)).alias("_stop")
        )
        state = materialize(state.filter("_stop OR up IS NULL").select(*key, "up", "node", "_stop").unionByName(moved))
    return state.select(*key, "node", F.when(F.col("_stop"), F.col("up")).alias("ancestor"))


def blockers(rules: dict[str, Column]) -> Column:
    """Array of the blocker codes that apply to a session; exportable iff it is empty."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in rules.items()]))


def spread_blocked(nodes: DataFrame, edges: DataFrame, blocked: DataFrame, node: str = "session_ref", src: str = "session_ref", dst: str = "parent_ref") -> DataFrame:
    """Nodes that reach a blocked or missing node along dependency edges, the blocked ones included.

    Runs backwards over the edges, so the result is again a node set.
    """
    known = nodes.select(node)
    links = materialize(edges.select(F.col(dst).alias("node"), F.col(src).alias("up")).distinct())
    missing = links.join(known.withColumnRenamed(node, "node"), "node", "left_anti").select(F.col("up").alias("node"))
    reached = _reach(blocked.select(F.col(node).alias("node")).union(missing).distinct(), links)
    return reached.withColumnRenamed("node", node).join(known, node, "left_semi")


def closure_pairs(roots: DataFrame, edges: DataFrame, node: str = "session_ref", src: str = "session_ref", dst: str = "parent_ref") -> DataFrame:
    """(root, member) for the given roots along dependency edges, the roots themselves included.

    Only for results that need the pairs themselves; each round joins and appends the new ones only.
    """
    links = materialize(edges.select(F.col(src).alias("member"), F.col(dst).alias("_dep")).distinct())
    fresh = seen = materialize(roots.select(F.col(node).alias("root"), F.col(node).alias("member")).distinct())
    while True:
        found = fresh.join(links, "member").select("root", F.col("_dep").alias("member")).distinct()
        fresh = materialize(found.join(seen, ["root", "member"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)


def _greedy(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates (root, place) that a pass in the order of `place` accepts; claims: root, resource, owner.

    Two candidates exclude each other if they need one resource from different owners. A candidate is accepted in a round
    if every candidate before it that is still open agrees with it, and leaves when it contradicts an accepted one; the
    first open candidate is always decided, so the rounds end with what the sequential pass gives.
    """
    open_, accepted = materialize(claims.join(candidates, "root")), candidates.join(claims.select("root").distinct(), "root", "left_anti").select("root")
    while not open_.isEmpty():
        least = open_.groupBy("resource", "owner").agg(F.min("place").alias("_first"))
        # The two owners of a resource that come first tell, for each owner, when another one comes first.
        heads = least.groupBy("resource").agg(F.min(F.struct("_first", "owner")).alias("_a"), F.min("_first").alias("_m"))
        others = least.join(heads, "resource").filter(F.col("owner") != F.col("_a.owner")).groupBy("resource").agg(F.min("_first").alias("_b"))
        rivals = open_.join(heads.join(others, "resource", "left"), "resource")
        rival = F.when(F.col("owner") == F.col("_a.owner"), F.col("_b")).otherwise(F.col("_m"))
        good = materialize(rivals.groupBy("root", "place").agg(F.min(F.coalesce(rival > F.col("place"), F.lit(True))).alias("_good")).filter("_good").select("root"))
        taken = open_.join(good, "root", "left_semi").select("resource", F.col("owner").alias("_owner")).distinct()
        lost = open_.join(taken, "resource").filter("owner <> _owner").select("root").distinct()
        accepted = materialize(accepted.unionByName(good))
        open_ = materialize(open_.join(good, "root", "left_anti").join(lost, "root", "left_anti"))
    return accepted


def select_exportable(
    requested: DataFrame, nodes: DataFrame, edges: DataFrame, blocked: DataFrame, owned: DataFrame, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(sessions to export with their closure, skipped sessions with a reason).

    ``edges``: all dependencies, several per session allowed. ``owned``: session_ref, resource; a resource can be
    exported for one owner only. A session is a candidate iff nothing in its closure is blocked or missing and no two
    members own one resource. Candidates are tried by size of their closure, larger first, then by reference; one that
    needs a resource which an accepted closure takes from another owner is skipped.
    """
    bad = materialize(spread_blocked(nodes, edges, blocked))
    asked = requested.select("session_ref").distinct()
    good = asked.join(bad, "session_ref", "left_anti")
    pairs = closure_pairs(good, edges)
    sizes = pairs.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    claims = materialize(pairs.join(owned.select(F.col("session_ref").alias("member"), "resource").distinct(), "member").select("root", "resource", F.col("member").alias("owner")))
    torn = claims.groupBy("root", "resource").agg((F.min("owner") != F.max("owner")).alias("_torn")).filter("_torn").select("root").distinct()
    refused = asked.join(bad, "session_ref", "left_semi").unionByName(torn.withColumnRenamed("root", "session_ref"))
    if strict:
        first = refused.orderBy("session_ref").head(1)
        if first:
            raise ValueError(f"session cannot be exported: {first[0][0]}")
    place = F.struct((-F.col("_size")).alias("size"), F.col("root").alias("ref"))
    candidates = sizes.join(torn, "root", "left_anti").select("root", place.alias("place"))
    chosen = _greedy(candidates, claims.join(torn, "root", "left_anti"))
    losers = candidates.join(chosen, "root", "left_anti").select(F.col("root").alias("session_ref"))
    if strict and not losers.isEmpty():
        raise ValueError(f"session cannot be exported: {losers.orderBy('session_ref').head(1)[0][0]}")
    exported = pairs.join(chosen, "root", "left_semi").select(F.col("member").alias("session_ref")).distinct()
    skipped = refused.withColumn("reason", F.lit("closure_blocked")).unionByName(losers.withColumn("reason", F.lit("ownership_conflict")))
    return exported, skipped


def relation_keys(sessions: DataFrame, component: DataFrame | None = None) -> DataFrame:
    """(session_ref, relation_key) rows: the own id always, related ids only where the relation is valid.

    ``sessions``: session_ref, agent, native_id, relation_valid, related ARRAY of native ids.
    """
    own = sessions.select("session_ref", F.concat_ws(":", "agent", "native_id").alias("relation_key"))
    valid = sessions.filter("relation_valid")
    related = valid.select("session_ref", "agent", F.explode("related").alias("_id")).filter("_id IS NOT NULL AND _id <> ''")
    rows = own.unionByName(related.select("session_ref", F.concat_ws(":", "agent", "_id").alias("relation_key")))
    if component is not None:
        members = component.join(valid.select("session_ref", "agent"), "session_ref")
        rows = rows.unionByName(members.select("session_ref", F.concat_ws(":", "agent", "member_id").alias("relation_key")))
    return rows.distinct()


def lineages(digests: DataFrame, keys: DataFrame) -> DataFrame:
    """(session_ref, lineage_ref): sessions that share a logical digest or a relation key.

    Bipartite star edges session -- value: a value shared by a third of all sessions is one hub,
    never a clique. The lineage reference hashes the component's distinct digests and keys.
    """
    values = digests.select("session_ref", F.concat(F.lit("d|"), "logical_digest").alias("value")).unionByName(
        keys.select("session_ref", F.concat(F.lit("k|"), "relation_key").alias("value"))
    )
    values = materialize(values)
    links = values.select(F.concat(F.lit("s|"), "session_ref").alias("src"), F.col("value").alias("dst"))
    nodes = digests.select(F.concat(F.lit("s|"), "session_ref").alias("session_ref"))
    labels = components(nodes, links).select(F.substring("session_ref", 3, 1 << 30).alias("session_ref"), "component_ref")
    labels = materialize(labels)
    members = lookup_join(values, labels, ["session_ref"], "inner", ["value"]).select("component_ref", "value").distinct()
    refs = members.groupBy("component_ref").agg(multiset_digest("lineage1_", F.sha2("value", 256)).alias("lineage_ref"))
    return lookup_join(labels, refs, ["component_ref"], "inner", ["session_ref"]).select("session_ref", "lineage_ref")
