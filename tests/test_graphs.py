"""Dependency graphs and reachability: tasks and joins against plain Python, deep graphs in few jobs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import access, graphs, workflow

SCHEMA = "graph int, node string, parent string"


def plain(rows, rule):
    """Fixpoint by sweeping over all nodes of all graphs."""
    parents = {}
    for g, n, p in rows:
        own = parents.setdefault((g, n), set())
        if p is not None:
            own.add((g, p))
    value, changed = {}, True
    while changed:
        changed = False
        for n, own in parents.items():
            if n in value:
                continue
            known = [value.get(p) for p in own]
            new = None
            if rule == "level" and None not in known:
                new = max(known, default=-1) + 1
            if rule == "unblocked":
                new = 0 if 1 in known else 1 if None not in known else None
            if new is not None:
                value[n], changed = new, True
    return {n: value.get(n) for n in parents}


def made(rng, graphs_n=12):
    rows = []
    for g in range(graphs_n):
        n = rng.randint(1, 30)
        for i in range(n):
            rows.append((g, f"n{i}", None))
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                j = rng.randrange(max(1, i)) if rng.random() < 0.93 else rng.randrange(n + 2)  # now and then forward, itself or absent
                rows.append((g, f"n{i}", f"n{j}"))
    rows += rows[::7]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule,whole", [(graphs.LEVEL, 10**6), (graphs.LEVEL, 0), (graphs.UNBLOCKED, 10**6), (graphs.UNBLOCKED, 25)])
def test_values_equal_a_plain_fixpoint(spark, rule, whole):
    rows = made(random.Random(whole + len(rule.name)), 5 if whole < 100 else 40)
    if rule is graphs.UNBLOCKED:  # parents that are no nodes are cut before
        nodes = {(g, n) for g, n, _ in rows}
        rows = [r for r in rows if r[2] is None or (r[0], r[2]) in nodes]
    got = {(r.graph, r.node): r.value for r in graphs.solve(spark.createDataFrame(rows, SCHEMA), rule, whole).collect()}
    assert got == plain(rows, rule.name)
    assert None in got.values() and len({v for v in got.values() if v is not None}) > 1


def jobs(spark, run):
    spark.sparkContext.setJobGroup("counted", "counted")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    result = run()
    spark.sparkContext.setJobGroup("", "")
    return result, len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before)


@pytest.mark.parametrize("whole,most", [(graphs.WHOLE, 15), (0, 120)])
def test_a_long_chain_takes_few_jobs(spark, whole, most):
    """2,000 steps in a row: one pass in a task, some doublings by joins, no round per level."""
    n = 2_000 if whole else 300
    steps = spark.range(n).select(
        F.lit(1).alias("workflow_id"), F.concat(F.lit("s"), "id").alias("step_id"),
        F.when(F.col("id") > 0, F.array(F.concat(F.lit("s"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    got, count = jobs(spark, lambda: {r.step_id: r.level for r in workflow.dag_levels(steps, whole).collect()})
    assert got == {f"s{i}": i for i in range(n)}
    assert count < most


def test_skipping_by_joins(spark):
    rng = random.Random(3)
    rows = [(1, f"s{i}", [f"s{j}" for j in {rng.randrange(max(1, i)) for _ in range(rng.choice([0, 1, 2]))} if j != i], rng.random() < 0.2) for i in range(60)]
    steps = spark.createDataFrame(rows, "workflow_id int, step_id string, depends_on array<string>, continue_on_error boolean")
    results = spark.createDataFrame([(1, f"s{i}", rng.choice(["Failed", "Failed", "Success"])) for i in range(60)], "workflow_id int, step_id string, status string")
    whole, joins = (sorted(map(tuple, workflow.propagate_status(steps, results, w).collect())) for w in (10**6, 0))
    assert whole == joins
    status = {r.step_id: r.status for r in results.collect()}
    final = {}
    for _, s, deps, goes_on in rows:  # dependencies come earlier
        final[s] = "Skipped" if not goes_on and any(final[d] == "Failed" for d in deps) else status[s]
    assert {s: v for _, s, v in whole} == final and "Skipped" in final.values()


def closure(roles):
    out = set()
    for role in roles:
        todo, seen = [role], {role}
        while todo:
            for p in roles.get(todo.pop(), []):
                if p in roles and p not in seen:
                    seen.add(p)
                    todo.append(p)
        out |= {(role, a) for a in seen}
    return out


@pytest.mark.parametrize("most", [graphs.REACH_ROWS, 0])
def test_role_closure(spark, most):
    rng = random.Random(7)
    roles = {f"r{i}": [f"r{rng.randrange(34)}" for _ in range(rng.choice([0, 1, 1, 2]))] for i in range(30)}
    df = spark.createDataFrame([(r, [], p) for r, p in roles.items()], "role string, permissions array<string>, inherits_from array<string>")
    assert {tuple(r) for r in access.role_closure(df, most).collect()} == closure(roles)
    assert access.role_closure(df.limit(0), most).count() == 0


def test_deep_roles_take_few_jobs(spark):
    roles = spark.range(1_000).select(
        F.concat(F.lit("r"), "id").alias("role"), F.array(F.concat(F.lit("p"), "id")).alias("permissions"),
        F.when(F.col("id") > 0, F.array(F.concat(F.lit("r"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("inherits_from"))
    users = spark.createDataFrame([("u", "r999")], "user_id string, role string")
    got, count = jobs(spark, lambda: access.role_closure(roles).count())
    assert got == 500_500 and count < 10
    assert access.effective_permissions(users, roles).count() == 1_000


def test_policy_is_not_shuffled_by_request(spark):
    rules = spark.createDataFrame(
        [("allow-read", "Allow", 5, ["read:*"], []), ("deny-all", "Deny", 1, ["*"], []), ("deny-night", "Deny", 9, ["read:db"], [("hour", "LessThan", "6", None)])],
        "rule_id string, effect string, priority int, actions array<string>, conditions array<struct<field:string,op:string,value:string,values:array<string>>>")
    requests = spark.createDataFrame(
        [(1, "read:db", {"hour": "3"}), (2, "read:db", {"hour": "9"}), (3, "write:db", {}), (3, "write:db", {}), (None, "read:x", {}), (4, None, {})],
        "id int, action string, context map<string,string>")
    decided = access.policy_decide(requests, rules)
    got = sorted(map(tuple, decided.collect()), key=repr)
    assert got == sorted([(1, "read:db", False, "deny-night"), (2, "read:db", True, "allow-read"), (3, "write:db", False, "deny-all"),
                          (3, "write:db", False, "deny-all"), (None, "read:x", True, "allow-read"), (4, None, False, None)], key=repr)
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan
