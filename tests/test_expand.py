import random

import pytest

from accessloom.operators import expand as X
from accessloom.operators import graph as G
from tests.helpers import entitlements, grants, shown


def naive(rows, ents, edges, plan):
    """Expansion row by row, by the definition."""
    state = {}
    for n, (gid, ent, kind, pid, sources) in enumerate(rows):
        state[n] = [gid, ent, kind, pid, dict(sources)]
    members = {}
    for e, n in plan.node.items():
        members.setdefault(n, []).append(e)
    fresh = len(rows)
    for node in sorted(plan.layer, key=plan.layer.get):
        incoming = [(a, spec) for (a, b), spec in plan.edges.items() if b == node]
        if not incoming:
            continue
        given = {}
        for a, (shallow, types) in incoming:
            for s in members[a]:
                for gid, ent, kind, pid, sources in list(state.values()):
                    if ent != s or kind is None or pid is None or (types and kind not in types):
                        continue
                    direct = not sources or s in sources
                    if shallow and not direct:
                        continue
                    own = given.setdefault((kind, pid), {})
                    own[s] = own.get(s, False) or direct
        for d in members[node]:
            if d not in ents:
                continue
            for (kind, pid), add in given.items():
                own = [k for k, r in state.items() if (r[1], r[2], r[3]) == (d, kind, pid)]
                for k in own:
                    base = state[k][4] or {d: True}
                    state[k][4] = {s: base.get(s, False) or add.get(s, False) for s in {*base, *add}}
                if not own:
                    state[fresh] = [f"{d}:{kind}:{pid}", d, kind, pid, dict(add)]
                    fresh += 1
    return {(g, e, k, p, tuple(sorted(s.items()))) for g, e, k, p, s in state.values()}


def check(spark, rows, ents):
    g, e = grants(spark, rows), entitlements(spark, ents)
    edges = G.collected(G.edges(g, e))
    plan = G.plan(edges)
    base = [(r.external_id, r.entitlement_id, r.principal_resource_type_id, r.principal_resource_id, r.sources) for r in g.collect()]
    out = X.expand(g, e).grants
    assert shown(out) == naive(base, set(ents), edges, plan)
    return g, e, out


def rule(src, shallow=False, types=()):
    return ([src], shallow, list(types))


def test_worked_example(spark):
    ents = [f"group:{x}:member" for x in "abc"]
    rows = [
        ("group:a:member", "user", "alice"), ("group:a:member", "svc", "bob"), ("group:b:member", "user", "alice"), ("group:b:member", "user", "carol"),
        ("group:b:member", "group", "a", None, rule("group:a:member")), ("group:c:member", "group", "b", None, rule("group:b:member", True)),
    ]
    _, _, out = check(spark, rows, ents)
    found = {(e, p): dict(s) for _, e, _, p, s in shown(out)}
    assert found["group:b:member", "alice"] == {"group:b:member": True, "group:a:member": True}
    assert found["group:b:member", "bob"] == {"group:a:member": True}
    assert ("group:c:member", "bob") not in found  # synthesised rows are not direct: the shallow edge drops them
    assert found["group:c:member", "alice"] == {"group:b:member": True} and found["group:c:member", "carol"] == {"group:b:member": True}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    ents = [f"group:{i}:member" for i in range(9)]
    rows = [(rng.choice(ents), rng.choice(["user", "svc"]), f"p{rng.randrange(6)}", {rng.choice(ents): True} if rng.random() < 0.1 else None) for _ in range(22)]
    rows += [(rng.choice(ents), None, None)]
    for _ in range(10 + 2 * seed):
        a, b = rng.sample(range(9), 2)
        if seed < 2 and a > b:  # acyclic
            a, b = b, a
        rows.append((ents[b], "group", str(a), None, rule(ents[a], rng.random() < 0.3, ["user"] if rng.random() < 0.3 else [])))
    rows.append((ents[0], "group", "77", None, rule("group:77:member")))  # its source is not there
    g, e, out = check(spark, rows, ents)
    again = X.run(out, e, G.plan(G.collected(G.edges(g, e)))).grants
    assert shown(again) == shown(out)


def test_cycles_share_inputs_but_do_not_grant_to_each_other(spark):
    ents = [f"group:{x}:member" for x in "abxy"]
    rows = [
        ("group:a:member", "user", "u1"), ("group:b:member", "user", "u2"), ("group:x:member", "user", "u3"),
        ("group:a:member", "group", "b", None, rule("group:b:member")), ("group:b:member", "group", "a", None, rule("group:a:member")),
        ("group:a:member", "group", "x", None, rule("group:x:member")), ("group:y:member", "group", "b", None, rule("group:b:member")),
        ("group:x:member", "group", "x", None, rule("group:x:member")),
    ]
    g, e, out = check(spark, rows, ents)
    pairs = {(ent, p) for _, ent, _, p, _ in shown(out)}
    assert ("group:b:member", "u3") in pairs and ("group:a:member", "u2") not in pairs and ("group:y:member", "u1") in pairs
    assert G.plan(G.collected(G.edges(g, e))).cyclic == [["group:a:member", "group:b:member"], ["group:x:member"]]


def test_edges_merge_and_mismatches_fail(spark):
    ents = [f"group:{x}:member" for x in "ab"]
    rows = [("group:b:member", "group", "a", None, rule("group:a:member", True, ["user"])), ("group:b:member", "group", "a", None, rule("group:a:member", False, ["svc"]))]
    [edge] = G.edges(grants(spark, rows), entitlements(spark, ents)).collect()
    assert (edge.shallow, edge.types) == (False, ["svc", "user"])
    wrong = grants(spark, [("group:b:member", "group", "zz", None, rule("group:a:member"))])
    with pytest.raises(G.GraphError):
        X.expand(wrong, entitlements(spark, ents))
    chain = [(f"g:{i}:m", f"g:{i + 1}:m", False, []) for i in range(30)]
    with pytest.raises(G.GraphError):
        G.plan(chain, depth=20)
    assert max(G.plan(chain).layer.values()) == 30


def test_rollback_undoes_expansion_and_incremental_equals_full(spark):
    ents = [f"group:{i}:member" for i in range(5)]
    rows = [("group:0:member", "user", "u0"), ("group:1:member", "user", "u1"), ("group:3:member", "user", "u0")]
    rows += [(ents[i + 1], "group", str(i), None, rule(ents[i])) for i in range(3)]
    g, e, out = check(spark, rows, ents)
    assert shown(X.rollback(out)) == shown(g)
    changed = {r.external_id for r in X.sources_changed(g, out).collect()}
    assert changed == {x[0] for x in shown(out) ^ shown(g)}
    late = grants(spark, [("group:1:member", "user", "new"), (ents[4], "group", "3", None, rule(ents[3]))])
    before, after = G.edges(g, e), G.edges(g.unionByName(late), e)
    step = X.expand_changes(out.unionByName(late), e, before, after, ["group:1:member"])
    assert step.mode == "incremental"
    assert shown(step.grants) == shown(X.expand(g.unionByName(late), e).grants)
    narrowed = X.expand_changes(out, e, after, before, [])
    assert narrowed.mode == "full: narrowed" and shown(narrowed.grants) == shown(out)
    dense = X.expand_changes(out.unionByName(late), e, before, after, [], least_nodes=2)
    assert dense.mode == "full: dense"


def test_suspect_rows_can_be_kept(spark):
    g = grants(spark, [("group:a:member", "user", "u", {"group:z:member": True}), ("group:a:member", "user", "v", {"group:a:member": True, "group:z:member": True})])
    assert {r.external_id: (r.action, r.suspect) for r in X.classify_rollback(g).collect()} == {"group:a:member:user:u": ("delete", True), "group:a:member:user:v": ("clear", False)}
    assert X.rollback(g, preserve_suspect=True).count() == 2
