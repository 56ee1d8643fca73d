"""Budgeted sampling, packing, and the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from convhist.operators.ordered import ranked, running_sum, scan
from convhist.operators.skew import lookup_join
from convhist.session import materialize

# Card limits and request overhead of the planner.
REQUEST_OVERHEAD_TOKENS = 1_200
MAX_CARDS_PER_REQUEST = 8
DEFAULT_FAST_TOKENS = 50_000
DEFAULT_DEEP_TOKENS = 128_000
DEFAULT_REQUEST_TOKENS = 64_000
MIN_CARD_TOKENS = 17
DEEP_REQUESTS = 4


def spread_position(index: Column, size: Column) -> Column:
    """Sort key of a 0-based index: first, last, then midpoints level by level, left to right.

    The bisection depth is found by halving the interval that holds the index; 63 halvings cover
    any bigint. The result packs (depth, index) into one comparable struct.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("low"), (size - 1).cast("bigint").alias("high"), F.lit(-1).alias("depth")
    )

    def step(state: Column, level: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("bigint")
        hit = index == middle
        return F.when(state["depth"] >= 0, state).otherwise(
            F.struct(
                F.when(index > middle, middle).otherwise(state["low"]).alias("low"),
                F.when(index < middle, middle).otherwise(state["high"]).alias("high"),
                F.when(hit, level).otherwise(F.lit(-1)).alias("depth"),
            )
        )

    levels = F.sequence(F.lit(1), F.lit(63))
    inner = F.aggregate(levels, start, step, lambda state: state["depth"])
    depth = F.when(index == 0, F.lit(-1)).when(index == size - 1, F.lit(0)).otherwise(inner)
    return F.struct(depth.alias("depth"), index.alias("index"))


def temporal_spread(cards: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """Exact breadth-first temporal order inside each stratum.

    Ranks come from range partitions, so a stratum holding most of the corpus is still spread over
    many tasks. Adds ``spread_depth``, ``spread_index`` and ``stratum_size``.
    """
    rows = ranked(cards, strata, order, "_rank", "stratum_size").withColumn("_index", F.col("_rank") - 1)
    rows = rows.withColumn("_spread", spread_position(F.col("_index"), F.col("stratum_size")))
    return (
        rows.withColumn("spread_depth", F.col("_spread.depth").cast("bigint"))
        .withColumn("spread_index", F.col("_index"))
        .drop("_rank", "_index", "_spread")
    )


def spread_place(cards: DataFrame, strata: list[str]) -> DataFrame:
    """1-based place of each card in the breadth-first order of its stratum."""
    return ranked(cards, strata, ["spread_depth", "spread_index"], "spread_place")


def stratified_order(cards: DataFrame, time: str = "user_ts") -> DataFrame:
    """Round-robin order over strata (project, lineage): spread place, then lineage rank, then project.

    Returns the cards with three sortable columns; take a prefix with ``orderBy(...).limit(n)``,
    which Spark runs as a distributed top-n. Strata are ranked on their distinct list, not on cards.
    """
    strata = ["project_key", "lineage_ref"]
    known = cards.withColumn("_unknown", F.col(time).isNull())  # unknown times come last
    spread = spread_place(temporal_spread(known, strata, ["_unknown", time, "card_ref"]).drop("_unknown"), strata)
    groups = ranked(cards.select(*strata).distinct(), ["project_key"], ["lineage_ref"], "lineage_rank")
    return lookup_join(spread, groups, strata, "inner", ["card_ref"])


ORDER_COLUMNS = ("spread_place", "lineage_rank", "project_key")


def plan_budget(
    ordered: DataFrame, total_tokens: int, deep_tokens: int = DEFAULT_DEEP_TOKENS,
    request_tokens: int = DEFAULT_REQUEST_TOKENS, order: tuple[str, ...] = ORDER_COLUMNS,
) -> tuple[DataFrame, DataFrame]:
    """Take cards in order until the next one would exceed the total; returns (picked cards, summary).

    Requests are next-fit batches, so :func:`pack_batches` numbers them; what a prefix costs is the running sum of its
    tokens plus the overhead of its requests, and the first card beyond the total is the stop. No card list is gathered.
    A card costs at least ``MIN_CARD_TOKENS``, so places past ``total_tokens / MIN_CARD_TOKENS`` are left out before
    packing. An oversize card before the stop raises, as does a bad budget.
    """
    for value in (total_tokens, deep_tokens, request_tokens):
        if not isinstance(value, int) or value < 0:
            raise ValueError("token budgets must be non-negative integers")
    one, limit = F.lit(1).cast("bigint"), max(request_tokens - REQUEST_OVERHEAD_TOKENS, 0)
    slim = ordered.select(*order, "card_ref", F.col("estimated_tokens").alias("tokens")).withColumn("_all", one)
    placed = ranked(slim, ["_all"], [*order, "card_ref"], "_rank").select("_all", (F.col("_rank") - 1).alias("place"), "card_ref", "tokens")
    placed = materialize(placed.filter(F.col("place") <= total_tokens // MIN_CARD_TOKENS))
    fitting = placed.withColumn("_fit", F.least("tokens", F.lit(limit)))
    packed = pack_batches(fitting, ["_all"], "place", "_fit", limit + REQUEST_OVERHEAD_TOKENS).select("_all", "place", "card_ref", "tokens", F.col("batch_no").alias("request_no"))
    spent = materialize(scan(packed, ["_all"], "place", {"_sum": running_sum(F.col("tokens"))}))
    total = F.col("_sum") + REQUEST_OVERHEAD_TOKENS * F.col("request_no")
    state = spent.agg(F.min(F.when(total > total_tokens, F.col("place"))).alias("stop"), F.min(F.when(F.col("tokens") > limit, F.struct("place", "card_ref"))).alias("big")).head()
    if state["big"] is not None and (state["stop"] is None or state["big"]["place"] <= state["stop"]):
        raise ValueError(f"card exceeds the request token budget: {state['big']['card_ref']}")
    picked = spent if state["stop"] is None else spent.filter(F.col("place") < state["stop"])
    zero, selected = F.lit(0).cast("bigint"), F.col("selected")
    taken = picked.agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.max(total), zero).alias("total"), F.coalesce(F.max("request_no"), zero).alias("requests"))
    count = ordered.agg(F.count(F.lit(1)).alias("total_cards"))
    deep = F.when((selected == 0) | (selected < F.col("total_cards")), 0).otherwise(deep_tokens).cast("bigint")
    # Two one-row results side by side: union and a maximum per column.
    both = taken.unionByName(count, allowMissingColumns=True)
    summary = both.agg(*[F.max(c).alias(c) for c in ("total_cards", "selected", "total", "requests")]).select(
        "total_cards",
        selected.alias("selected_cards"),
        (F.col("total_cards") - selected).alias("remaining_cards"),
        F.col("total").alias("fast_input_tokens"),
        F.col("requests").alias("fast_requests"),
        deep.alias("deep_input_tokens"),
        F.when(deep == 0, 0).otherwise(DEEP_REQUESTS).cast("bigint").alias("deep_requests"),
    )
    return picked.select("place", "card_ref", "request_no", "tokens"), summary


PACK_CHUNK = 1_024


def pack_batches(
    rows: DataFrame, keys: list[str], order: str, tokens: str, max_tokens: int,
    max_rows: int = MAX_CARDS_PER_REQUEST, overhead: int = REQUEST_OVERHEAD_TOKENS, chunk: int = PACK_CHUNK,
) -> DataFrame:
    """Next-fit packing in order, exact, for keys of any size. Adds ``batch_no`` (1-based).

    ``order`` is a dense 0-based position per key. Which rows open a batch depends on all rows
    before, but only through one small number: how many leading rows still belong to the batch
    that is already open (fewer than ``max_rows``). So every chunk is a function from that number
    to (number handed on, batches opened). Chunks of ``chunk`` rows are folded into functions,
    ``chunk`` neighbouring functions into one, and so on until a key has one list of at most
    ``chunk`` functions; on the way back each function gets what enters it. No list is longer than
    ``chunk``, whatever the size of a key.
    """
    wide = _with_reach(rows.select(*keys, order, tokens), keys, order, tokens, max_tokens - overhead, max_rows, chunk)
    seen = Observation()
    leaves = wide.groupBy(*keys, F.col("_c1").alias("_c")).agg(_in_order(order, "_reach").alias("_steps"))
    leaves = materialize(leaves.observe(seen, F.max("_c").alias("last")))
    last = int(seen.get.get("last") or 0)
    maps = leaves.select(*keys, "_c", _as_map(max_rows, lambda entry: _walk(F.col("_steps"), entry)).alias("_map"))
    lists = []
    while last >= chunk:
        parents = maps.withColumn("_up", F.expr(f"_c div {chunk}L")).groupBy(*keys, "_up").agg(_in_order("_c", "_map").alias("_maps"))
        lists.append(materialize(parents))
        through = _as_map(max_rows, lambda entry: _through(F.col("_maps"), entry))
        maps, last = lists[-1].select(*keys, F.col("_up").alias("_c"), through.alias("_map")), last // chunk
    # At most `chunk` functions of a key are left: their list is bounded.
    top = maps.groupBy(*keys).agg(_in_order("_c", "_map").alias("_maps"))
    start = F.struct(F.lit(0).alias("left"), F.lit(0).cast("bigint").alias("opened"))
    enter = top.select(*keys, F.posexplode(_entries(F.col("_maps"), start)).alias("_c", "_in")).withColumn("_c", F.col("_c").cast("bigint"))
    for parents in reversed(lists):
        inside = parents.join(enter.withColumnRenamed("_c", "_up"), [*keys, "_up"])
        inside = inside.select(*keys, "_up", F.posexplode(_entries(F.col("_maps"), F.col("_in"))).alias("_p", "_in"))
        enter = inside.select(*keys, (F.col("_up") * chunk + F.col("_p")).alias("_c"), "_in")
    numbers = leaves.join(enter, [*keys, "_c"]).select(
        *keys, F.posexplode(_numbers(F.col("_steps"), F.col("_in"))).alias("_p", "batch_no"), "_c"
    )
    numbers = numbers.select(*keys, (F.col("_c") * chunk + F.col("_p")).alias(order), "batch_no")
    return rows.join(numbers, [*keys, order])


def _with_reach(rows, keys, order, tokens, limit, max_rows, chunk) -> DataFrame:
    """Rows that a batch opened here would hold, from at most ``max_rows - 1`` rows of look-ahead.

    The first rows of each chunk also go to the chunk before it, so the window stays inside chunks.
    """
    own = rows.withColumn("_c1", F.expr(f"`{order}` div {chunk}L")).withColumn("_ahead", F.lit(False))
    lead = own.filter((F.col(order) % chunk < max_rows - 1) & (F.col("_c1") > 0)).withColumn(
        "_c1", F.col("_c1") - 1
    ).withColumn("_ahead", F.lit(True))
    window = Window.partitionBy(*keys, "_c1").orderBy(order).rowsBetween(0, max_rows - 1)
    following = F.collect_list(F.col(tokens)).over(window)
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def fill(state: Column, value: Column) -> Column:
        fits = state["open"] & (state["sum"] + value <= limit)
        return F.struct(
            (state["sum"] + F.when(fits, value).otherwise(0)).alias("sum"),
            (state["n"] + F.when(fits, 1).otherwise(0)).alias("n"),
            fits.alias("open"),
        )

    reach = F.aggregate("_following", start, fill, lambda state: state["n"])
    both = own.unionByName(lead).withColumn("_following", following).filter(~F.col("_ahead"))
    oversize = F.raise_error(F.lit("a row exceeds the batch token budget")).cast("int")
    return both.withColumn("_reach", F.when(F.col(tokens) > limit, oversize).otherwise(reach)).drop("_following", "_ahead")


def _in_order(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda row: row[value])


def _state(left: Column, opened: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), opened.cast("bigint").alias("opened"))


def _step(state: Column, reach: Column) -> Column:
    """One row: it continues the open batch, or opens one that will hold ``reach`` rows."""
    inside = state["left"] > 0
    return _state(
        F.when(inside, state["left"] - 1).otherwise(reach - 1), state["opened"] + F.when(inside, 0).otherwise(1)
    )


def _apply(state: Column, mapping: Column) -> Column:
    hit = F.element_at(mapping, state["left"] + 1)
    return _state(hit["left"], state["opened"] + hit["opened"])


def _walk(steps: Column, entry: Column) -> Column:
    return F.aggregate(steps, _state(entry, F.lit(0)), _step)


def _through(maps: Column, entry: Column) -> Column:
    return F.aggregate(maps, _state(entry, F.lit(0)), _apply)


def _as_map(max_rows: int, function) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(max_rows - 1)), function)


_ENTRIES = "array<struct<left:int,opened:bigint>>"


def _entries(maps: Column, start: Column) -> Column:
    """State in front of every function of the list."""
    first = _state(start["left"], start["opened"])
    zero = F.struct(first.alias("now"), F.array().cast(_ENTRIES).alias("out"))
    return F.aggregate(
        maps, zero,
        lambda s, m: F.struct(_apply(s["now"], m).alias("now"), F.array_append(s["out"], s["now"]).alias("out")),
        lambda s: s["out"],
    )


def _numbers(steps: Column, start: Column) -> Column:
    zero = F.struct(_state(start["left"], start["opened"]).alias("now"), F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, reach: Column) -> Column:
        after = _step(state["now"], reach)
        return F.struct(after.alias("now"), F.array_append(state["out"], after["opened"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda s: s["out"])


def select_requests(requests: DataFrame, keys: list[str], request_limit: int, total_limit: int) -> DataFrame:
    """Skip a request over the per-request or the remaining budget and keep trying later ones.

    ``requests``: keys, scope, request_no, tokens, cached. A key has at most one request per scope
    (four scopes), which a distinct aggregate guarantees before the fold, so each list is tiny.
    """
    unique = requests.groupBy(*keys, "scope").agg(
        F.min_by(F.struct("request_no", "tokens", "cached"), F.col("request_no")).alias("r")
    )
    lists = unique.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("r.request_no").alias("request_no"), "scope", F.col("r.tokens").alias("tokens"), F.col("r.cached").alias("cached")))).alias("_list")
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.array().cast("array<struct<scope:string,request_no:bigint,tokens:bigint,status:string>>").alias("out"),
    )

    def step(state: Column, row: Column) -> Column:
        status = (
            F.when(row["cached"], "cached")
            .when(row["tokens"] > request_limit, "pending_request_limit")
            .when(state["used"] + row["tokens"] > total_limit, "pending_budget")
            .otherwise("completed")
        )
        used = state["used"] + F.when(status == "completed", row["tokens"]).otherwise(0)
        out = F.struct(row["scope"].alias("scope"), row["request_no"].alias("request_no"), row["tokens"].alias("tokens"), status.alias("status"))
        return F.struct(used.alias("used"), F.array_append(state["out"], out).alias("out"))

    return lists.select(*keys, F.inline(F.aggregate("_list", start, step, lambda s: s["out"])))


def usage_totals(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Token usage over requests and the number of repaired requests."""
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if("repaired").alias("repaired"),
    )


def cache_key(schema: Column, prompt: Column, profile: Column, content: Column) -> Column:
    from convhist.functions.ids import framed_digest

    return F.concat(F.lit("cache1_"), framed_digest(schema, prompt, profile, content))


def cache_lookup(cards: DataFrame, cache: DataFrame, versions: list[str]) -> DataFrame:
    """Left join on the cache key; a hit must also carry the same versions. Adds ``hit``."""
    stored = cache.select("cache_key", *[F.col(v).alias(f"_{v}") for v in versions], "result")
    same = F.lit(True)
    for version in versions:
        same = same & F.col(version).eqNullSafe(F.col(f"_{version}"))
    joined = lookup_join(cards, stored, ["cache_key"], "left")
    hit = F.coalesce(F.col("result").isNotNull() & same, F.lit(False))
    return joined.withColumn("hit", hit).withColumn("result", F.when(hit, F.col("result"))).drop(*[f"_{v}" for v in versions])


def cache_upsert(cache: DataFrame, fresh: DataFrame, key: str = "cache_key", at: str = "completed_at") -> DataFrame:
    """Union of stored and fresh rows; the latest completion per key wins (map-side combined)."""
    rows = cache.unionByName(fresh)
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, F.xxhash64(*others))).alias("_b"))
    return best.select(key, "_b.*")


def cache_invalidate(
    index: DataFrame, updated_sessions: DataFrame, current_cards: DataFrame, results: DataFrame, groupings: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards, results and groupings that survive an update of some sessions.

    A card of an updated session that is no longer current goes; its results go with it; a grouping
    goes as soon as one of its cards is missing.
    """
    touched = index.join(updated_sessions, "session_ref", "left_semi")
    dropped = touched.join(current_cards, "card_ref", "left_anti").select("card_ref")
    kept = index.join(dropped, "card_ref", "left_anti")
    kept_results = results.join(kept.select("card_ref"), "card_ref", "left_semi")
    broken = groupings.join(kept.select("card_ref"), "card_ref", "left_anti").select("group_ref").distinct()
    return kept, kept_results, groupings.join(broken, "group_ref", "left_anti")
