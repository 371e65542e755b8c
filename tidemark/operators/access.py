"""Policy rules, role inheritance and permission checks as equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import SECURITY_LEVELS
from tidemark.operators.graphs import REACH_ROWS, reach

# ------------------------------------------------------------------ policy


def _pattern_key(pattern: Column) -> Column:
    """('^', prefix) for a wildcard, ('=', text) for an exact action."""
    wild = pattern.endswith("*")
    return F.struct(
        F.when(wild, "^").otherwise("=").alias("kind"),
        F.when(wild, F.regexp_replace(pattern, r"\*+$", "")).otherwise(pattern).alias("text"),
    )


def _matching_keys(action: Column) -> Column:
    """Every key that covers ``action``: itself and each of its prefixes."""
    lengths = F.sequence(F.lit(0), F.char_length(action))
    prefixes = F.transform(lengths, lambda n: F.struct(F.lit("^").alias("kind"), F.substring(action, F.lit(1), n).alias("text")))
    return F.concat(F.array(F.struct(F.lit("=").alias("kind"), action.alias("text"))), prefixes)


def matching_rules(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """(action, rule_id) for distinct actions: exact, ``*`` and ``prefix*``.

    Wildcards become an equi join on prefixes, so neither side has to be
    compared with all of the other.
    """
    keys = (
        actions.select("action")
        .distinct()
        .select("action", F.explode(_matching_keys(F.col("action"))).alias("key"))
        .select("action", "key.*")
    )
    patterns = (
        rules.select("rule_id", F.explode("actions").alias("pattern"))
        .select("rule_id", _pattern_key(F.col("pattern")).alias("key"))
        .select("rule_id", "key.*")
        .distinct()
    )
    return keys.join(patterns, ["kind", "text"]).select("action", "rule_id").distinct()


def conditions_hold(conditions: Column, context: Column) -> Column:
    """All conditions true for the context map; a missing field fails each of them.

    A condition is ``struct<field, op, value, values>``; ``values`` is the list
    for In and NotIn and null when the rule gave no list.
    """

    def one(c: Column) -> Column:
        actual = F.try_element_at(context, c["field"])
        number, limit = actual.try_cast("double"), c["value"].try_cast("double")
        verdict = (
            F.when(c["op"] == "Equals", actual == c["value"])
            .when(c["op"] == "NotEquals", ~actual.eqNullSafe(c["value"]))
            .when(c["op"] == "In", F.array_contains(c["values"], actual))
            .when(c["op"] == "NotIn", F.coalesce(~F.array_contains(c["values"], actual), F.lit(True)))
            .when(c["op"] == "GreaterThan", number > limit)
            .when(c["op"] == "LessThan", number < limit)
            .when(c["op"] == "Contains", actual.contains(c["value"]))
        )
        return actual.isNotNull() & F.coalesce(verdict, F.lit(False))

    return F.coalesce(F.forall(conditions, one), F.lit(True))


def eval_conditions(df: DataFrame, conditions: str = "conditions", context: str = "context") -> DataFrame:
    return df.withColumn("holds", conditions_hold(F.col(conditions), F.col(context)))


def compiled_rules(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """(action, ranked): for each distinct action its rules, best first, with what is needed to try them."""
    own = matching_rules(actions, rules).join(rules.select("rule_id", "effect", "priority", "conditions"), "rule_id")
    one = F.struct((-F.col("priority")).alias("p"), "rule_id", "effect", "conditions")
    return own.groupBy("action").agg(F.sort_array(F.collect_list(one)).alias("ranked"))


def policy_decide(requests: DataFrame, rules: DataFrame, default: str = "Deny", key: str = "id") -> DataFrame:
    """(key, action, allowed, rule_id): best matching rule, else the default; one row per request.

    ``requests(key, action, context)``; ``rules(rule_id, effect, priority,
    actions, conditions)``. Highest priority wins, ties by rule id. Rules are
    compiled once per distinct action, and a request takes the first of its
    action's rules that holds: it is neither multiplied by rules nor shuffled
    by its key.
    """
    tried = requests.select(key, "action", "context").join(compiled_rules(requests, rules), "action", "left")
    holding = F.filter("ranked", lambda r: conditions_hold(r["conditions"], F.col("context")))
    best = tried.select(key, "action", F.try_element_at(holding, F.lit(1)).alias("best"))
    return best.select(
        key,
        "action",
        (F.coalesce(F.col("best.effect"), F.lit(default)) == "Allow").alias("allowed"),
        F.col("best.rule_id").alias("rule_id"),
    )


def policy_conflicts(rules: DataFrame) -> DataFrame:
    """Rule pairs of equal priority whose actions overlap (equal, or one covers the other)."""
    each = rules.select("rule_id", "priority", F.explode("actions").alias("pattern"))
    covers = each.select("rule_id", "priority", _pattern_key(F.col("pattern")).alias("key")).distinct()
    covered = each.select(
        F.col("rule_id").alias("other"), "priority", F.explode(_matching_keys(F.col("pattern"))).alias("key")
    ).distinct()
    return (
        covers.join(covered, ["priority", "key"])
        .filter(F.col("rule_id") != F.col("other"))
        .select(
            F.least("rule_id", "other").alias("rule_a"), F.greatest("rule_id", "other").alias("rule_b"), "priority"
        )
        .distinct()
    )


# ------------------------------------------------------------------ roles


def role_closure(roles: DataFrame, most: int = REACH_ROWS) -> DataFrame:
    """(role, ancestor) including the role itself; roles that are not in the table lead nowhere.

    Any depth and any cycles; see ``graphs.reach`` for small and large role graphs. Users are never iterated.
    """
    rows = roles.select(F.col("role").alias("node"), F.explode_outer("inherits_from").alias("parent"))
    return reach(rows, most).select(F.col("node").alias("role"), F.col("found").alias("ancestor"))


def effective_permissions(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct (user_id, permission), own and inherited.

    ``roles(role, permissions, inherits_from)``; unknown roles grant nothing.
    """
    granted = roles.select(F.col("role").alias("ancestor"), F.explode("permissions").alias("permission"))
    per_role = role_closure(roles).join(granted, "ancestor").select("role", "permission").distinct()
    return user_roles.join(per_role, "role").select("user_id", "permission").distinct()


def access_conditions_hold(conditions: Column) -> Column:
    """Conditions of a permission against the request row; unknown kinds fail closed.

    Request columns: ``hour``, ``tenant_id``, ``security_level``.
    """
    rank = lambda level: F.greatest(
        F.array_position(F.array(*[F.lit(v) for v in SECURITY_LEVELS]), F.lower(level)), F.lit(1)
    )

    def one(c: Column) -> Column:
        return F.coalesce(
            F.when(c["kind"] == "time_of_day", F.col("hour").between(c["start_hour"], c["end_hour"]))
            .when(c["kind"] == "tenant", F.col("tenant_id") == c["tenant_id"])
            .when(c["kind"] == "minimum_level", rank(F.col("security_level")) >= rank(c["level"])),
            F.lit(False),
        )

    return F.coalesce(F.forall(conditions, one), F.lit(True))


def authorize(requests: DataFrame, perms: DataFrame, permissions: DataFrame, key: str = "id") -> DataFrame:
    """(key, granted, matched): ``action:resource``, ``action:*``, ``*:resource``, ``admin:system``.

    ``requests(key, user_id, action, resource, hour, tenant_id, security_level)``,
    ``perms(user_id, permission)``, ``permissions(name, conditions)``. Each distinct
    (user, action, resource) is looked up once, by equi join on (user,
    permission), which also spreads a busy user over its permissions.
    """
    who = F.coalesce(F.col("user_id"), F.lit("anonymous"))
    requests = requests.withColumn("user_id", who)
    action, resource = F.col("action"), F.col("resource")
    forms = F.array(
        F.concat_ws(":", action, resource),
        F.concat(action, F.lit(":*")),
        F.concat(F.lit("*:"), resource),
        F.lit("admin:system"),
    )
    asked = (
        requests.select("user_id", "action", "resource")
        .distinct()
        .select("user_id", "action", "resource", F.posexplode(forms).alias("form", "permission"))
    )
    found = (
        asked.join(perms, ["user_id", "permission"])
        .groupBy("user_id", "action", "resource")
        .agg(F.min(F.struct("form", "permission")).alias("hit"))
        .select("user_id", "action", "resource", "hit.*")
        .join(permissions.select(F.col("name").alias("permission"), "conditions"), "permission", "left")
    )
    answered = requests.join(found, ["user_id", "action", "resource"], "left")
    # conditions hang on the exact and the admin form only
    checked = F.when(F.col("form").isin(0, 3), access_conditions_hold(F.col("conditions"))).otherwise(F.lit(True))
    return answered.select(
        key, F.when(F.col("form").isNull(), F.lit(False)).otherwise(checked).alias("granted"), F.col("permission").alias("matched")
    )


def apply_role_changes(user_roles: DataFrame, changes: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new user_roles, rejected changes); the last change per (user, role) counts.

    ``changes(seq, user_id, role, op)`` with op assign or revoke; assigning an
    unknown role is rejected.
    """
    known = roles.select("role").distinct()
    assigns = changes.filter(F.col("op") == "assign")
    rejected = assigns.join(known, "role", "left_anti")
    valid = changes.filter(F.col("op") == "revoke").unionByName(assigns.join(known, "role", "left_semi"), allowMissingColumns=True)
    last = valid.groupBy("user_id", "role").agg(F.max_by("op", "seq").alias("op"))
    kept = user_roles.select("user_id", "role").distinct().join(last, ["user_id", "role"], "left_anti")
    added = last.filter(F.col("op") == "assign").select("user_id", "role")
    return kept.unionByName(added), rejected


__all__ = [
    "access_conditions_hold",
    "apply_role_changes",
    "authorize",
    "conditions_hold",
    "effective_permissions",
    "eval_conditions",
    "matching_rules",
    "policy_conflicts",
    "policy_decide",
    "role_closure",
]
