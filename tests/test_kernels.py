"""Deterministic cases and randomised comparisons with sequential restatements."""

import random

import pytest
from pyspark.sql import functions as F

from convhist.functions import ids, paths, text
from convhist.operators import assembly as A
from convhist.operators import beats as B
from convhist.operators import budget as J
from convhist.operators import catalog as C
from convhist.operators import graphs as H
from convhist.operators import transfer as M

ITEM = "session_ref string, ordinal bigint, kind string, role string, ts timestamp_ntz, text string, code string, label string"


def _items(spark, specs):
    from datetime import datetime, timedelta

    start = datetime(2026, 7, 1)
    rows = [("s", i, "gap" if r == "gap" else "message", "" if r == "gap" else r, start + timedelta(minutes=i), t, "", "") for i, (r, t) in enumerate(specs)]
    return spark.createDataFrame(rows, ITEM)


@pytest.mark.parametrize("chunk_rows", [1, 100])
def test_beat_boundaries(spark, chunk_rows):
    envelope = '<<<CONVHIST_HISTORICAL_EVENT_V1>>>\n{"notice":"Historical event","source_agent":"x"}\n<<<END_CONVHIST_HISTORICAL_EVENT_V1>>>'
    items = _items(spark, [
        ("assistant", "hello"), ("user", "first " + "x" * 9000), ("assistant", "one"), ("system", "note"), ("assistant", envelope + " two"),
        ("user", "second"), ("gap", ""), ("assistant", "after gap"), ("user", "  "), ("assistant", "lost"), ("user", "third"),
    ])
    got = {r.turn_start: r for r in B.beats(items, chunk_rows).collect()}
    assert sorted(got) == [1, 5, 10]
    assert (got[1].turn_end, got[5].turn_end, got[10].turn_end) == (4, 6, 10)
    assert got[1].next_user_text == "second" and got[1].previous_user_text is None
    assert got[5].previous_user_truncated and len(got[5].previous_user_text) == 3072 and got[5].next_user_text is None
    assert got[10].previous_user_text is None  # an empty user message is a boundary, not a neighbour
    said = {(r.turn_start, r.side): [] for r in B.assistant_evidence(items, chunk_rows).collect()}
    for r in B.assistant_evidence(items, chunk_rows).orderBy("ordinal").collect():
        said[(r.turn_start, r.side)].append(r.text)
    assert said == {(1, "before"): ["hello"], (1, "after"): ["one", "two"], (5, "before"): ["one", "two"], (10, "before"): ["lost"]}


def test_envelopes(spark):
    good = '<<<CONVHIST_HISTORICAL_CONTEXT_V1>>>{"notice":"Historical context","source_agent":"a"}<<<END_CONVHIST_HISTORICAL_CONTEXT_V1>>>'
    bad = good.replace("Historical context", "else")
    cases = [(good, ""), ("a" + good + "b", "ab"), (bad, bad), ("<<<CONVHIST_HISTORICAL_CONTEXT_V1>>>" + good, "<<<CONVHIST_HISTORICAL_CONTEXT_V1>>>"), (" plain\u00a0", "plain")]
    df = spark.createDataFrame([(c, e) for c, e in cases], "t string, e string")
    assert all(r.got == r.e for r in df.withColumn("got", text.strip_envelopes(F.col("t"))).collect())


def test_split_text_whole_and_bounded(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "漢", "😀", "\n", "\n\n", " "]) for _ in range(rng.randint(0, 4000))) for _ in range(40)] + ["x" * 127 + "\n\ny" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    parts = {}
    for r in B.split_text(df, "t", 128).orderBy("i", "fragment_index").collect():
        parts.setdefault(r.i, []).append(r)
    for i, value in enumerate(texts):
        rows = parts.get(i, [])
        assert "".join(r.fragment_text for r in rows) == value
        assert all(0 < len(r.fragment_text.encode()) <= 129 for r in rows) and all(r.fragment_count == len(rows) for r in rows)


def test_budget_arithmetic(spark):
    rows = [(f"c{i:02}", "p", "l", i, 100) for i in range(17)]
    cards = spark.createDataFrame(rows, "card_ref string, project_key string, lineage_ref string, user_ts bigint, estimated_tokens bigint")
    ordered = J.stratified_order(cards)
    picked, summary = J.plan_budget(ordered, 5_300, request_tokens=12_000)
    row = summary.head()
    assert (row.fast_requests, row.fast_input_tokens, row.selected_cards, row.remaining_cards, row.deep_requests) == (3, 5_300, 17, 0, 4)
    assert [r.request_no for r in picked.orderBy("place").collect()] == [1] * 8 + [2] * 8 + [3]
    assert J.plan_budget(ordered, 5_299, request_tokens=12_000)[1].head().selected_cards == 16
    with pytest.raises(Exception, match="exceeds the request token budget"):
        J.plan_budget(ordered, 5_300, request_tokens=1_000)[1].collect()


def test_stratified_pick_covers_projects_and_lineages(spark):
    rows = [(f"{p}-{age}", p, f"lin-{p}", t, 100) for p in "abcd" for t, age in enumerate(("old", "new"))]
    cards = spark.createDataFrame(rows, "card_ref string, project_key string, lineage_ref string, user_ts bigint, estimated_tokens bigint")
    picked, _ = J.plan_budget(J.stratified_order(cards), 1_600, request_tokens=12_000)
    assert [r.card_ref for r in picked.orderBy("place").collect()] == ["a-old", "b-old", "c-old", "d-old"]


def test_temporal_spread_matches_queue(spark):
    for n in (1, 2, 3, 8, 37):
        order, seen = [0, n - 1][: min(n, 2)], [(0, n - 1)]
        while seen:
            low, high = seen.pop(0)
            if high - low > 1:
                mid = (low + high) // 2
                order.append(mid)
                seen += [(low, mid), (mid, high)]
        df = spark.createDataFrame([("s", i, f"c{i:03}") for i in range(n)], "k string, t bigint, card_ref string")
        rows = J.spread_place(J.temporal_spread(df, ["k"], ["t", "card_ref"]), ["k"]).orderBy("spread_place").collect()
        assert [r.t for r in rows] == order


@pytest.mark.parametrize("chunk", [3, 16, 1024])
def test_pack_batches_equals_next_fit(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, i, rng.randint(1, 60)) for k, n in (("a", 150), ("b", 9), ("c", 1)) for i in range(n)]
    got = {(r.k, r.pos): r.batch_no for r in J.pack_batches(spark.createDataFrame(rows, "k string, pos bigint, t bigint"), ["k"], "pos", "t", 100, 4, 0, chunk).collect()}
    for key in "abc":
        batch, total, n = 0, 0, 0
        for _, pos, t in [r for r in rows if r[0] == key]:
            if batch == 0 or n == 4 or total + t > 100:
                batch, total, n = batch + 1, 0, 0
            total, n = total + t, n + 1
            assert got[(key, pos)] == batch


@pytest.mark.parametrize("chunk_rows", [2, 1000])
def test_rollbacks_equal_fold(spark, chunk_rows):
    from datetime import datetime, timedelta

    rng, rows, expected = random.Random(3), [], set()
    for s in range(12):
        live, users, shut, protected = [], [], False, s % 3
        times = [rng.randint(0, 60) for _ in range(40)]
        for o in range(40):
            kind = rng.choices(["user", "assistant", "rollback", "opaque", "clear"], [4, 4, 3, 0.3, 1])[0]
            back = rng.randint(1, 3) if kind == "rollback" else None
            rows.append((f"s{s}", o, "message" if kind in ("user", "assistant") else "gap", kind if kind in ("user", "assistant") else "",
                         {"opaque": "x", "clear": "world_state", "rollback": "rollback"}.get(kind, ""), datetime(2026, 1, 1) + timedelta(seconds=times[o] * (s % 2) + o * 100 * (1 - s % 2)), back, s != 5))
        group = [r for r in rows if r[0] == f"s{s}"]
        stamps = [r[5] for r in group]
        for r in group:
            hit = r[6] is not None and r[7] and stamps.count(r[5]) == 1 and not shut and users
            if hit:
                cut = max(len(users) - r[6], 0)
                hit = cut >= protected
            if hit:
                live = [x for x in live if x < users[cut]]
                users = users[:cut]
            else:
                live.append(r[1])
                if r[3] == "user":
                    users.append(r[1])
                shut = shut or r[4] == "x" or r[6] is not None
        expected |= {(f"s{s}", o) for o in live}
    df = spark.createDataFrame(rows, "session_ref string, ordinal bigint, kind string, role string, code string, ts timestamp_ntz, rollback_turns bigint, eligible boolean")
    guard = spark.createDataFrame([(f"s{s}", s % 3) for s in range(12)], "session_ref string, protected bigint")
    assert {(r.session_ref, r.ordinal) for r in A.apply_rollbacks(df, guard, chunk_rows).collect()} == expected


def test_mirror_equals_greedy(spark):
    rng, model, shown, expected = random.Random(11), [], [], {}
    for s in range(15):
        keys = [rng.choice("ab") for _ in range(30)]
        picks = [k for k in keys if rng.random() < 0.6] if s % 3 else [rng.choice("ab") for _ in range(14)]
        model += [(f"s{s}", i, k) for i, k in enumerate(keys)]
        shown += [(f"s{s}", i, k) for i, k in enumerate(picks)]
        cursor, places = 0, []
        for k in picks:
            at = next((i for i in range(cursor, 30) if keys[i] == k), None)
            if at is None:
                places = None
                break
            places.append(at)
            cursor = at + 1
        expected[f"s{s}"] = places
    schema = "session_ref string, ordinal bigint, content_key string"
    state, verdict = A.reconcile_mirror(spark.createDataFrame(model, schema), spark.createDataFrame(shown, schema), 7)
    got = {r.session_ref: r.matched for r in verdict.collect()}
    for s, places in expected.items():
        assert got[s] == (places is not None)
        if places:
            assert [r["match"] for r in state.filter(F.col("session_ref") == s).orderBy("ordinal").collect()] == places


def test_components_on_hub_chain_and_singletons(spark):
    edges = [("h", f"x{i:02}") for i in range(40)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("y", "y")]
    nodes = sorted({n for e in edges for n in e} | {"lonely"})
    df = H.components(spark.createDataFrame([(n,) for n in nodes], "session_ref string"), spark.createDataFrame(edges, "src string, dst string"))
    got = {r.session_ref: r.component_ref for r in df.collect()}
    assert len(got) == len(nodes) and {got[f"c{i:02}"] for i in range(31)} == {"c00"}
    assert {got[f"x{i:02}"] for i in range(40)} == {"h"} and got["lonely"] == "lonely" and got["y"] == "y"


def test_lineages_merge_digest_and_key(spark):
    digests = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2"), ("d", "d3")], "session_ref string, logical_digest string")
    keys = spark.createDataFrame([("b", "k1"), ("c", "k1"), ("d", "k9")], "session_ref string, relation_key string")
    got = {r.session_ref: r.lineage_ref for r in H.lineages(digests, keys).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"]


def test_cycle_is_reported(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "session_ref string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "session_ref string, parent_ref string")
    assert {r.session_ref: r.level for r in H.topo_levels(nodes, edges).collect()} == {"a": None, "b": None, "c": None, "d": 0}
    heads = spark.createDataFrame([("a", "b", 1, False), ("b", "a", 1, False)], "session_ref string, base_ref string, cutoff bigint, compacted boolean")
    with pytest.raises(ValueError, match="cycle"):
        A.inherit_history(heads, spark.createDataFrame([("a", 0)], "session_ref string, record_no bigint"))


def test_paths(spark):
    posix = {"/a/./b//c/..": "/a/b", "a/../../b": "../b", "": ".", "/": "/", "/a/b/": "/a/b/", "/../x": "/x"}
    windows = {r"\\?\C:\Work\.\A": r"c:\work\a", r"\\?\UNC\Host\Share\x": r"\\host\share\x", "C:/Work/B/../A": r"c:\work\a"}
    for cases, flag in ((posix, False), (windows, True)):
        df = spark.createDataFrame(list(cases.items()), "p string, e string")
        assert {r.p: r.got for r in df.withColumn("got", paths.path_identity(F.col("p"), flag)).collect()} == cases


def test_mapping_prefers_longest_segment_prefix(spark):
    rules = spark.createDataFrame([("/a", "/x"), ("/a/b", "/y"), ("/q", "/z")], "source string, target string")
    df = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/n",), ("/a",)], "path string")
    rows, unused = M.map_paths(df, rules)
    assert {r.path: r.mapped for r in rows.collect()} == {"/a/b/c": "/y/c", "/a/bc": "/x/bc", "/n": "/n", "/a": "/x"}
    assert [r.source for r in unused.collect()] == ["/q"]


def test_limits_raise(spark, sf_dir):
    from convhist.operators.search import check_query

    for call in (lambda: C.check_page(-1, 50), lambda: C.check_page(0, 1001), lambda: C.in_view("none"), lambda: C.select_kinds(["x"]), lambda: check_query(""), lambda: check_query("é" * 300)):
        with pytest.raises(ValueError):
            call()


def test_normalize_phrase_uses_nfkc(spark):
    df = spark.createDataFrame([("Ｆｉｘ  the ﬁle!! Now",)], "t string")
    assert df.select(text.normalize_phrase(F.col("t"))).head()[0] == "fix the file now"


def test_cursor_rejects_foreign_text(spark):
    df = spark.createDataFrame([("cursor1_",), ("other",), ("cursor1_YQ==",), ("cursor1_YQ",)], "c string")
    assert [r[0] for r in df.select(ids.decode_cursor(F.col("c"))).collect()] == [None, None, None, "a"]


def _unified(rows, target):
    """Offsets by following each session's bases one by one."""
    by = {r[0]: r for r in rows}

    def growth(ref, seen):
        _, provider, base, offset, own = by[ref]
        own = own if provider != target else 0
        if base is None:
            return own
        if base not in by or base in seen:
            return None
        shift = growth(base, seen | {base})
        return None if shift is None else own + len(str(offset + shift)) - len(str(offset))

    out = {}
    for ref, _, base, offset, _ in rows:
        shift = growth(base, {ref, base}) if base in by and base != ref else None
        out[ref] = None if base is None or shift is None else offset + shift
    return out


def test_provider_unify_on_forests_cycles_and_missing_bases(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        base = None if rng.random() < 0.1 else f"s{rng.randrange(max(1, i))}" if rng.random() < 0.9 else rng.choice(["gone", f"s{rng.randrange(300)}"])
        rows.append((f"s{i}", rng.choice("pq"), base, None if base is None else rng.choice([8, 9, 95, 99, 998, 9_995, 10**9 - 3, 0]), rng.randrange(-9, 12)))
    schema = "session_ref string, provider string, base_ref string, base_offset bigint, own_delta bigint"
    got = {r.session_ref: r.after_offset for r in M.provider_unify(spark.createDataFrame(rows, schema), "q").collect()}
    assert got == _unified(rows, "q") and any(v is None for v in got.values())


def test_provider_unify_on_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, tables = 10_000, []
    rows = [(f"s{i}", "p", f"s{i - 1}" if i else None, 10 ** (i % 4 + 1) - 1 if i else None, i % 3) for i in range(n)]
    keep = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: tables.append(1) or keep(df))
    schema = "session_ref string, provider string, base_ref string, base_offset bigint, own_delta bigint"
    got = {r.session_ref: r.after_offset for r in M.provider_unify(spark.createDataFrame(rows, schema), "q").collect()}
    shift, want = 0, {"s0": None}
    for ref, _, _, offset, own in rows[1:]:
        want[ref] = offset + shift
        shift = own + len(str(want[ref])) - len(str(offset))
    assert got == want
    assert len(tables) <= 16  # the sessions, and one table a round


def _cuts(text, limit):
    """Fragment ends from the rule: the last place in the window that ends a blank line, else a line, else a character."""
    data, ends = text.encode(), []
    boundary = {len(text[:i].encode()) for i in range(len(text) + 1)}
    while (ends[-1] if ends else 0) < len(data):
        at = ends[-1] if ends else 0
        if len(data) - at <= limit:
            ends.append(len(data))
            break
        whole = max(x for x in boundary if x <= at + limit)
        half = at + (whole - at) // 2
        blanks = [x + 2 for x in range(half, whole) if data[x : x + 2] == b"\n\n"]
        lines = [x + 1 for x in range(half, whole) if data[x : x + 1] == b"\n"]
        ends.append((blanks or lines or [whole])[-1])
    return ends


def test_split_text_cuts_where_the_rule_says(spark):
    rng = random.Random(8)
    made = ["".join(rng.choices(["a", " ", "\n", "\n\n", "ä", "漢", "🎉", "word "], weights, k=rng.choice([1, 40, 300, 900]))) for weights in ([9, 3, 1, 1, 3, 3, 3, 3], [1, 1, 0, 0, 1, 5, 5, 1], [5, 5, 5, 5, 1, 1, 1, 1]) for _ in range(25)]
    made += ["", "x" * 64, "x" * 65, "\n" * 400, "é" * 33, "a" * 63 + "\n\n" + "b" * 90, "a" * 62 + "🎉" * 40]
    df = spark.createDataFrame(list(enumerate(made)), "i bigint, t string")
    plan = B.split_text(df, "t", 64)
    got = {}
    for r in plan.orderBy("i", "fragment_index").collect():
        got.setdefault(r.i, []).append(r.byte_end)
        assert made[r.i].encode()[r.byte_start : r.byte_end].decode() == r.fragment_text
    assert {i: got.get(i, []) for i in range(len(made))} == {i: _cuts(t, 64) for i, t in enumerate(made)}
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def _levels_by_peeling(nodes, edges):
    deps = {n: {d for s, d in edges if s == n and d in nodes} for n in nodes}
    level, left = {}, dict(deps)
    while True:
        ready = [n for n, d in left.items() if all(x in level for x in d)]
        if not ready:
            return {n: level.get(n) for n in nodes}
        for n in ready:
            level[n] = max((level[x] + 1 for x in deps[n]), default=0)
        left = {n: d for n, d in left.items() if n not in level}


def _reached_by_search(start, edges):
    out, todo = set(start), list(start)
    while todo:
        n = todo.pop()
        for s, d in edges:
            if s == n and d not in out:
                out.add(d)
                todo.append(d)
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_reach_and_levels_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(70)]
    # Chains with some branchings; seed 2 adds a ring of single successors with a tail, seed 3 back edges.
    edges = [(names[i], names[i - 1]) for i in range(1, 50) if i % 17] + [(names[i], names[rng.randrange(i)]) for i in range(20, 50, 7)]
    edges += [(names[60 + i], names[60 + (i + 1) % 6]) for i in range(6)] + [(names[68], names[67]), (names[67], names[62]), (names[40], "missing")] if seed == 2 else []
    edges += [(names[10], names[45])] if seed == 3 else []
    nodes = spark.createDataFrame([(n,) for n in names], "session_ref string")
    links = spark.createDataFrame(edges, "session_ref string, parent_ref string")
    got = {r.session_ref: r.level for r in H.topo_levels(nodes, links).collect()}
    assert got == _levels_by_peeling(set(names), edges)
    start = [names[49], names[68], names[33]]
    found, missing = H.closure(spark.createDataFrame([(n,) for n in start], "session_ref string"), links, nodes)
    rows = [r.session_ref for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) | {r.session_ref for r in missing.collect()} == _reached_by_search(start, edges)
    blocked = spark.createDataFrame([(names[3],)], "session_ref string")
    back = _reached_by_search([names[3], "missing"], [(d, s) for s, d in edges]) - {"missing"}
    assert {r.session_ref for r in H.spread_blocked(nodes, links, blocked).collect()} == back


def test_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    stored = []
    real = H.materialize
    monkeypatch.setattr(H, "materialize", lambda df: stored.append(1) or real(df))
    n = 10_000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("session_ref"))
    links = spark.range(1, n).select(F.col("id").cast("string").alias("session_ref"), (F.col("id") - 1).cast("string").alias("parent_ref"))
    found, _ = H.closure(nodes.filter(f"session_ref = '{n - 1}'"), links, nodes)
    assert found.count() == n and len(stored) < 45  # a table per round: 4 plain, 15 doublings, 15 from the jumps
    stored.clear()
    wrong = H.topo_levels(nodes, links).filter("level <> cast(session_ref as bigint) OR level IS NULL")
    assert wrong.isEmpty() and len(stored) < 25


def _digests(spark, kind, sessions, extra=""):
    from datetime import datetime

    rows = [(s, 0, "message", "user", datetime(2026, 7, 1), text, "", "", blocks) for s, (text, blocks) in sessions.items()]
    df = spark.createDataFrame(rows, f"{ITEM}, blocks array<struct<{kind}{extra}>>")
    return {r.session_ref: r.logical_digest for r in B.logical_digest(df).collect()}


def test_logical_digest_tells_evidence_apart(spark):
    kind = "kind string, text string, reference struct<locator:string, title:string>, summary array<string>, resource struct<name:string, relative_path:string, size_bytes:bigint>"
    said = ("text", "hi", None, None, None)
    at = lambda place, title=None: ("reference", None, (place, title), None, None)
    file = lambda name, path, size: ("resource", None, None, None, (name, path, size))
    sessions = {
        "plain": ("hi", [said]), "none": ("hi", None), "tool": ("hi", [said, ("tool", None, None, None, None)]),
        "ref_a": ("hi", [said, at("/a")]), "ref_a2": ("hi", [at("/a"), said]), "ref_b": ("hi", [said, at("/b")]), "ref_title": ("hi", [said, at("/a", "")]),
        "two": ("hi", [said, at("/a"), at("/b")]), "swapped": ("hi", [said, at("/b"), at("/a")]),
        "steps": ("hi", [said, ("reasoning", None, None, ["x", None], None)]), "step": ("hi", [said, ("reasoning", None, None, ["x"], None)]),
        "file": ("hi", [said, file("n", "/here", 3)]), "moved": ("hi", [said, file("n", "/there", 3)]), "grown": ("hi", [said, file("n", "/here", 4)]),
    }
    got = _digests(spark, kind, sessions)
    same = [{"plain", "none", "tool"}, {"ref_a", "ref_a2"}, {"ref_b"}, {"ref_title"}, {"two"}, {"swapped"}, {"steps"}, {"step"}, {"file", "moved"}, {"grown"}]
    assert sorted(sorted(s for s in got if got[s] == d) for d in set(got.values())) == sorted(sorted(g) for g in same)
    wider = {s: (text, blocks and [(*b, None) for b in blocks]) for s, (text, blocks) in sessions.items()}
    assert _digests(spark, kind, wider, ", work_items array<struct<id:string>>") == got  # an unused member changes nothing


def test_logical_digest_reads_embedded_evidence(spark):
    mark = "<<<CONVHIST_{0}_V1>>>\n{1}\n<<<END_CONVHIST_{0}_V1>>>"
    note = lambda name, body: "hi " + mark.format(name, '{"notice":"Historical x","source_agent":"a",' + body + "}")
    sessions = {
        "plain": ("hi", None), "tool": (note("HISTORICAL_TOOL_EVIDENCE", '"call_id":"c"'), None),
        "one": (note("HISTORICAL_REFERENCE", '"b":1,"a":{"y":[1,2],"x":null}'), None), "order": (note("HISTORICAL_REFERENCE", '"a":{"x":null,"y":[1,2]},"b":1'), None),
        "other": (note("HISTORICAL_REFERENCE", '"a":{"x":null,"y":[2,1]},"b":1'), None), "name": (note("HISTORICAL_RESOURCE", '"a":{"x":null,"y":[1,2]},"b":1'), None),
        "against": (note("HISTORICAL_REFERENCE", '"a":{"x":null,"y":[1,2]},"b":1,"resolve_against":"/z"'), None),
    }
    got = _digests(spark, "kind string, text string", sessions)
    same = [{"plain", "tool"}, {"one", "order", "against"}, {"other"}, {"name"}]
    assert sorted(sorted(s for s in got if got[s] == d) for d in set(got.values())) == sorted(sorted(g) for g in same)


def test_inherit_history_on_long_chains(spark, monkeypatch):
    rng, n = random.Random(5), 120
    heads = {i: (i - 1 if i % 50 else None, rng.choice([None, 1, 2, 3]) if i % 50 else None, i % 37 == 20) for i in range(n)}
    heads[60] = (59, 0, False)  # nothing of what is further up
    heads[118] = (500, 2, False)  # a base that doesn't exist
    expected = set()
    for s in heads:
        owner, cut, distance = s, None, 0
        while owner in heads:
            expected |= {(str(s), str(owner), r, distance) for r in range(3) if cut is None or r < cut}
            base, limit, compacted = heads[owner]
            if base is None or compacted:
                break
            cut = limit if cut is None else cut if limit is None else min(cut, limit)
            owner, distance = base, distance + 1
    schema = "session_ref string, base_ref string, cutoff bigint, compacted boolean"
    text = lambda v: None if v is None else str(v)
    sessions = spark.createDataFrame([(str(s), text(b), c, z) for s, (b, c, z) in heads.items()], schema)
    records = spark.createDataFrame([(str(s), r) for s in heads for r in range(3)], "session_ref string, record_no bigint")
    stored = []
    real = A.materialize
    monkeypatch.setattr(A, "materialize", lambda df: stored.append(1) or real(df))
    rows = [(r.session_ref, r.owner, r.record_no, r.distance) for r in A.inherit_history(sessions, records).collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert len(stored) <= 16  # chains of 50 bases: six doublings
    ring = spark.createDataFrame([("a", "b", None, False), ("b", "a", None, False)], schema)
    with pytest.raises(ValueError, match="cycle"):
        A.inherit_history(ring, records)
    assert A.inherit_history(sessions, records.limit(0)).collect() == []


def _retract(spark, claims):
    """Verdicts of episodes (session, number) that claim lists of messages."""
    messages = sorted({(s, m) for (s, _), ids in claims.items() for m in ids})
    items = [(s, i, "assistant", "message", m) for i, (s, m) in enumerate(messages)]
    items += [(s, 1_000_000 + e, "assistant", "message", f"r{e}") for s, e in claims]
    episodes = [(s, e, f"r{e}", ids) for (s, e), ids in claims.items()]
    _, verdicts = A.apply_retractions(
        spark.createDataFrame(items, "session_ref string, ordinal bigint, role string, kind string, message_id string"),
        spark.createDataFrame(episodes, "session_ref string, episode_no bigint, replacement_id string, superseded array<string>"),
    )
    return {(r.session_ref, r.episode_no): r.applied for r in verdicts.collect()}


def test_retractions_are_decided_in_order(spark, monkeypatch):
    rng = random.Random(3)
    claims = {("dense", e): [f"m{rng.randrange(25)}" for _ in range(rng.randint(1, 3))] for e in range(40)}
    claims |= {("sparse", e): [f"m{rng.randrange(90)}" for _ in range(rng.randint(1, 2))] for e in range(40)}
    expected, gone = {}, set()
    for (s, e), ids in sorted(claims.items()):
        expected[s, e] = not gone & {(s, m) for m in ids}
        gone |= {(s, m) for m in ids} if expected[s, e] else set()
    assert _retract(spark, claims) == expected
    stored = []
    for module in (A, H):
        monkeypatch.setattr(module, "materialize", lambda df, real=module.materialize: stored.append(1) or real(df))
    chain = {("c", e): [f"m{e:04}", f"m{e + 1:04}"] for e in range(5_000)}
    assert _retract(spark, chain) == {("c", e): e % 2 == 0 for e in range(5_000)}
    assert len(stored) < 25  # one round of thirteen doublings


SENTENCES = [
    ["Hello there. ", "How are you? ", "Fine!"],
    ["Version 3.4 is out, e.g. the U.S.A. build etc. and more. ", "Next one."],
    ["Wait... what?! ", "No."],
    ["He said \"stop.\" ", "Then (really!) ", "left."],
    ["Yes!, he said. ", "Done"],
    ["你好。", "再见！（", "好。）", "完"],  # an opening mark is a closing one to the rules
    ["one\n", "\n", "two\r\n", "three\r", "four. \n", " five"],
    ["See p. ", "5. ", "See fig. ", "Five"],  # only a lower-case letter further on holds a blank and a digit back
    ["a.b c.D (x.) ", "Y. ", "«Z.» ", "W"],
    ["no mark at all"],
    ["   "],
    ["..."],
    ["x. 1 is lower. ", "2 IS not"],
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, "".join(parts)) for i, parts in enumerate(SENTENCES)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", text.sentences(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(SENTENCES))] == SENTENCES


def test_sentences_of_odd_texts_are_the_text(spark):
    rng = random.Random(11)
    texts = ["", "a" * 200_000, "a. " * 20_000, "." * 50_000 + "x", "\n" * 5_000]
    texts += ["".join(rng.choice("aB1.!?,\"') \n\r。é\u2028") for _ in range(40)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.sentences(F.col("t")).alias("s")).collect()
    assert all("".join(r.s) == r.t and "" not in r.s for r in rows)


def test_every_alias_of_a_request_is_proposed(spark):
    from convhist.operators import groups as L
    from convhist.plans import evidence_queries as E

    ref = "request1_f" + "0" * 63
    aliases = spark.createDataFrame([(ref, f"a{i}", f"occ{i:04}") for i in range(400)], "request_ref string, alias string, occurrence_ref string")
    asked = E._asked(aliases)
    proposed = E._proposed(asked)
    assert proposed.selectExpr("explode(event_ids) AS alias").join(aliases, "alias").select("alias").distinct().count() == 399  # the last alias is alone in its group
    issues, members, rest = L.validate_groups(proposed, asked)
    assert {c for r in issues.collect() for c in r.issues} == {"relation", "unknown_member", "too_many_groups", "members", "duplicate_members"}
    bad = {r.request_ref for r in issues.collect()}
    good = [r.occurrence_ref for r in asked.collect() if r.request_ref not in bad]
    assert len(bad) == 10 and len(good) == 400 - 210
    assert sorted(r.occurrence_ref for r in members.unionByName(rest, True).collect()) == sorted(good)
    assert [r.occurrence_ref for r in rest.collect()] == ["occ0399"]


def test_reached_nodes_are_one_table(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 60)] + [(100, 101)], "node long, up long")
    for start, found in ((59, list(range(60))), (100, [100, 101])):
        reached = H._reach(spark.createDataFrame([(start,)], "node long"), links)
        assert sorted(r.node for r in reached.collect()) == found
        assert "Union" not in reached._jdf.queryExecution().optimizedPlan().toString()


def test_mirror_rounds_leave_settled_sessions_alone(spark, monkeypatch):
    schema = "session_ref string, ordinal bigint, content_key string"
    model = [("easy", i, f"k{i}") for i in range(6)] + [("hard", i, k) for i, k in enumerate("abcabcabc")]
    shown = [("easy", i, f"k{i}") for i in range(6)] + [("hard", i, k) for i, k in enumerate("cbab")]
    real, seen = A.scan, []

    def spy(df, *rest):
        seen.append({r.session_ref for r in df.select("session_ref").distinct().collect()})
        return real(df, *rest)

    monkeypatch.setattr(A, "scan", spy)
    state, verdict = A.reconcile_mirror(spark.createDataFrame(model, schema), spark.createDataFrame(shown, schema), 3)
    got = {(r.session_ref, r.ordinal): r.match for r in state.collect()}
    assert got == {**{("easy", i): i for i in range(6)}, **dict(zip([("hard", i) for i in range(4)], (2, 4, 6, 7), strict=True))}
    assert {(r.session_ref, r.matched) for r in verdict.collect()} == {("easy", True), ("hard", True)}
    assert len(seen) > 3 and all(s == {"hard"} for s in seen[3:])


def test_rejected_requests_are_asked_again(spark):
    from convhist.operators import groups as L
    from convhist.plans import evidence_queries as E

    ref = "request1_f" + "0" * 63
    aliases = spark.createDataFrame([(ref, f"a{i}", f"occ{i:04}") for i in range(400)], "request_ref string, alias string, occurrence_ref string")
    asked = E._asked(aliases)
    issues, members, rest = L.validate_groups(E._proposed(asked), asked)
    assert members.count() == 190 - 1 and issues.count() == 10
    members, rest = E._settled(asked, issues, members, rest)
    assert sorted(r.occurrence_ref for r in members.unionByName(rest, True).collect()) == [f"occ{i:04}" for i in range(400)]
    assert [r.occurrence_ref for r in rest.collect()] == ["occ0399"]
    sizes = [r["count"] for r in members.groupBy("group_ref").count().collect()]
    assert sorted(set(sizes)) == [3, 9, 12] and sizes.count(12) == sizes.count(9) == 10


def test_routing_accounts_for_every_occurrence(spark, tmp_path):
    from convhist.plans import evidence_queries as E

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}", "m") for c in range(40) for t in range(8)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, model string").write.parquet(f"{tmp_path}/conversations.parquet")
    totals = E.routing_totals(spark, str(tmp_path)).collect()
    assert sum(r.occurrences for r in totals) > 100 and all(r.occurrences == r.grouped + r.unrouted for r in totals)
    audit = E.audit_complete(spark, str(tmp_path)).collect()
    assert audit and all("-" not in r.request_ref for r in audit)
    grouped = sum(r.grouped for r in totals)
    assert sum(r.occurrences for r in E.group_metrics(spark, str(tmp_path)).collect()) == grouped


def test_stored_visible_texts_give_the_same_beats(spark):
    from convhist.session import materialize

    rng = random.Random(5)
    pieces = [" ", "\n", "\u0085", "\u2028", "a", "word", "\u3000", "\u00e9", "<<<CONVHIST_X_V1>>>"]
    rows = [(f"s{s}", i, rng.choice(["message", "message", "message", "gap"]), rng.choice(["user", "assistant"]), None,
             None if rng.random() < 0.05 else "".join(rng.choices(pieces, k=rng.randrange(7))), "c", "l") for s in range(12) for i in range(25)]
    items = spark.createDataFrame(rows, ITEM)
    stored = materialize(B.spoken_items(items))
    for build in (B.beats, B.assistant_evidence, lambda df, **known: B.logical_digest(df, **known)):
        assert sorted(map(repr, build(stored, known=True).collect())) == sorted(map(repr, build(items).collect()))


def test_guarded_trim_is_the_pattern(spark):
    rng = random.Random(6)
    odd = " \t\n\r\u0085\u00a0\u2028\u3000\ufeffab\u200b\u00e9\U0001d4b3"
    texts = [None, "", "\u0085", "a \u0085", "a\u0085 ", " \r\n", "a\r\n"] + ["".join(rng.choices(odd, k=rng.randrange(9))) for _ in range(500)]
    plain = F.regexp_replace("t", rf"^{text._SPACE}+|{text._SPACE}+$", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.trim_space(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in rows)
