"""Threat, rate-limit, policy, role and workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixed_values import RISKY_COMMAND_TEXT, SCRIPT_PATTERNS, SQL_PATTERNS, UNDELETABLE_PATHS
from tidemark.operators import access, ratelimit, threats, workflow
from tidemark.plans.views import SQL_STAMP, STAMP
from tidemark.session import table

HOUR = 3600 * 1_000_000

# ----------------------------------------------------------------- threats
# The shared events are sparse, so windows are wider than the defaults.


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("source"),
        "event_type", "value", F.col("value").alias("bytes"),
        F.when(F.col("event_type") == "error", "Failure").otherwise("Success").alias("outcome"),
    )


def brute_force(spark, sf_dir):
    failures = _events(spark, sf_dir).filter(F.col("outcome") == "Failure")
    out = threats.brute_force(failures, threshold=3, window=48 * HOUR)
    return out.select("id", "source", "attempts")


def rate_abuse(spark, sf_dir):
    return threats.rate_abuse(_events(spark, sf_dir), limit=5, window=24 * HOUR).select("id", "source", "requests")


def exfiltration(spark, sf_dir):
    out = threats.exfiltration(_events(spark, sf_dir), limit=300, window=6 * HOUR)
    return out.select("source", F.date_format("slot", STAMP).alias("slot"), F.round("total_bytes", 4).alias("total_bytes"))


PATTERNS = [
    threats.ThreatPattern("brute_force_login", "failures", "High", 48 * HOUR, 3),
    threats.ThreatPattern("rate_limit_abuse", "requests", "Medium", 24 * HOUR, 5),
    threats.ThreatPattern("data_exfiltration", "bytes", "High", 6 * HOUR, 300),
]


def threat_patterns(spark, sf_dir):
    out = threats.detect(_events(spark, sf_dir), PATTERNS)
    return out.withColumn("peak", F.round("peak", 4))


_WINDOWED_SQL = """WITH e AS (SELECT event_id AS id, epoch_us(ts) AS t, user_id AS source, event_type, value FROM events),
    b AS (SELECT id, source, count(*) OVER (PARTITION BY source ORDER BY t
        RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW) AS attempts FROM e WHERE event_type = 'error'),
    r AS (SELECT id, source, count(*) OVER (PARTITION BY source ORDER BY t
        RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS requests FROM e),
    x AS (SELECT source, t // 21600000000 AS slot, sum(value) AS total_bytes FROM e GROUP BY 1, 2 HAVING sum(value) >= 300)
    """


def injection_scan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"), F.col("html").alias("body"))
    return threats.scan_requests(pages).select("page_id", "threat_type", "severity", "confidence", "matched_pattern")


def sql_injection_text(spark, sf_dir):
    """The same scan over prose and event rows written as form bodies."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("request_id"), F.concat(F.lit("/doc/"), "doc_id").alias("uri"), F.col("text").alias("body")
    )
    n = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), n).alias("request_id"),
        F.concat(F.lit("/event/"), n).alias("uri"),
        F.when(n % 17 == 0, F.concat(F.lit("username=user_"), "user_id", F.lit("' OR '1'='1")))
        .when(n % 17 == 1, F.concat(F.lit("q=1 UNION  SELECT "), "value"))
        .when(n % 17 == 2, F.lit("x=1; Drop Table t"))
        .when(n % 17 == 3, F.concat(F.lit("<IFRAME a=1 SRC="), "value", F.lit(">")))
        .when(n % 17 == 4, F.lit("<a onclick =go()>"))
        .when(n % 17 == 5, F.lit(None))
        .otherwise(F.col("props"))
        .alias("body"),
    )
    return threats.scan_requests(docs.unionByName(events)).select("request_id", "threat_type", "matched_pattern")


def _scan_sql(content: str) -> str:
    words = {r"(?i)on\w+\s*=": r"(?i)on[\p{L}\p{M}\p{N}\p{Pc}]+[\s\p{Z}]*="}
    cases = []
    for kind, patterns in (("sql_injection", SQL_PATTERNS), ("xss_attack", SCRIPT_PATTERNS)):
        for p in patterns:
            run = words.get(p, p).replace("'", "''")
            cases.append(f"WHEN regexp_matches({content}, '{run}') THEN '{kind}|{p.replace(chr(39), chr(39) * 2)}'")
    return "CASE " + " ".join(cases) + " END"


def _positions(df):
    return df.select(
        "event_id", "user_id",
        (F.col("user_id") % 50 + F.when(F.col("event_id") % 7 == 0, 20.0).otherwise(0.5)).alias("lat"),
        (F.col("user_id") % 60).cast("double").alias("lon"),
        F.concat(F.lit("agent_"), F.col("event_id") % 4).alias("user_agent"),
    )


def baseline_anomaly(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    users = events.select("user_id").distinct().filter(F.col("user_id") % 3 != 0)
    place = lambda lat, lon: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    u = F.col("user_id")
    baselines = users.select(
        "user_id",
        F.array(place(u % 50, u % 60), place(u % 50 + 1, u % 60 + 2)).alias("locations"),
        F.array(F.lit("agent_0"), F.lit("agent_1"), F.lit("agent_2")).alias("user_agents"),
    )
    out = threats.baseline_anomalies(_positions(events), baselines)
    return out.select("event_id", "user_id", "threat_type", "severity", "confidence")


def bad_ip(spark, sf_dir):
    events = _events(spark, sf_dir)
    listed = events.groupBy("source").agg(F.max("value").alias("peak")).filter(F.col("peak") > 150).select("source")
    return threats.blocklist_hits(events, listed).select("id", "source", "event_type")


def geo_distance(spark, sf_dir):
    e = _positions(table(spark, sf_dir, "events"))
    km = threats.geo_km(F.col("lat"), F.col("lon"), F.col("user_id").cast("double"), F.lit(10.0))
    return e.select("event_id", F.round(km, 6).alias("km"))


def client_ip(spark, sf_dir):
    n = F.col("event_id")
    forwarded = (
        F.when(n % 5 == 0, F.concat(F.lit(" 10.1."), n % 256, F.lit(".7 , 9.9.9.9")))
        .when(n % 5 == 1, "unknown, 1.2.3.4")
        .when(n % 5 == 2, F.concat(F.lit("2001:db8::"), n % 100))
    )
    real = F.when(n % 3 == 0, F.concat(F.lit("8.8.8."), n % 300))
    headers = F.create_map(F.lit("X-Forwarded-For"), forwarded, F.lit("x-real-ip"), real)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", threats.client_ip(headers, True).alias("ip"))


# -------------------------------------------------------------- rate limit

RATES = ratelimit.RateConfig(
    per_minute=3, per_hour=6, burst=2, minute=86_400, hour=5 * 86_400, burst_window=14_400,
    minute_block=43_200, hour_block=86_400, burst_block=21_600,
)


def rate_decision(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"), F.col("event_id").alias("id"), F.col("ts").alias("timestamp")
    )
    return ratelimit.rate_limit(requests, RATES)


_RATE_SQL = """WITH RECURSIVE q AS (SELECT user_id AS client_id, event_id AS id, epoch_us(ts) AS t,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (
      SELECT client_id, id, n, 'allowed' AS verdict, [t] AS kept, CAST(0 AS BIGINT) AS until FROM q WHERE n = 1
      UNION ALL
      SELECT client_id, id, n, verdict,
        CASE WHEN verdict = 'allowed' THEN list_append(kept, t) ELSE kept END,
        CASE verdict WHEN 'minute_exceeded' THEN t + 43200000000 WHEN 'hour_exceeded' THEN t + 86400000000
            WHEN 'burst_exceeded' THEN t + 21600000000 ELSE until END
      FROM (SELECT q.client_id, q.id, q.n, q.t, f.kept, f.until, CASE WHEN q.t < f.until THEN 'blocked'
            WHEN len(list_filter(f.kept, lambda x: q.t - x < 86400000000)) >= 3 THEN 'minute_exceeded'
            WHEN len(list_filter(f.kept, lambda x: q.t - x < 432000000000)) >= 6 THEN 'hour_exceeded'
            WHEN len(list_filter(f.kept, lambda x: q.t - x < 14400000000)) >= 2 THEN 'burst_exceeded'
            ELSE 'allowed' END AS verdict
        FROM f JOIN q ON q.client_id = f.client_id AND q.n = f.n + 1))
    SELECT client_id, id, verdict FROM f"""

# ------------------------------------------------------------------ policy


def _rules(spark, sf_dir):
    """One rule per nation; every fifth is a catch-all for its priority."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    kind = F.element_at(kinds, (n % 5 + 1).cast("int"))
    text = lambda v: F.lit(v).cast("string")
    condition = F.when(
        n % 3 == 1,
        F.struct(text("region").alias("field"), text("Equals").alias("op"), r.cast("string").alias("value"),
                 F.lit(None).cast("array<string>").alias("values")),
    ).when(
        n % 3 == 2,
        F.struct(text("hour").alias("field"), text("GreaterThan").alias("op"), (n % 12).cast("string").alias("value"),
                 F.lit(None).cast("array<string>").alias("values")),
    )
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("rule_id"),
        F.when(n % 2 == 0, "Allow").otherwise("Deny").alias("effect"),
        (n % 7).alias("priority"),
        F.when(n % 10 == 9, F.array(F.lit("*")))
        .when(n % 2 == 0, F.array(F.concat(kind, F.lit(":res_1*"))))
        .otherwise(F.array(F.concat(kind, F.lit(":res_"), (n % 20).cast("string")), F.concat(kind, F.lit(":*"))))
        .alias("actions"),
        F.filter(F.array(condition), lambda c: c.isNotNull()).alias("conditions"),
    )


_RULES_SQL = """rules AS (SELECT n_name AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Allow' ELSE 'Deny' END AS effect,
    n_nationkey % 7 AS priority, n_nationkey AS n, n_regionkey AS r,
    ['click', 'view', 'purchase', 'signup', 'error'][n_nationkey % 5 + 1] AS kind,
    CASE WHEN n_nationkey % 10 = 9 THEN ['*'] WHEN n_nationkey % 2 = 0 THEN [kind || ':res_1*']
        ELSE [kind || ':res_' || (n_nationkey % 20), kind || ':*'] END AS actions FROM nation)"""


def _requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    context = F.create_map(
        F.lit("hour"), F.hour("ts").cast("string"), F.lit("region"), (F.col("event_id") % 6).cast("string")
    )
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.col("event_type"), F.lit(":res_"), F.col("event_id") % 20).alias("action"),
        context.alias("context"),
    )


def policy_conditions(spark, sf_dir):
    n = F.col("event_id")
    events = table(spark, sf_dir, "events")
    ops = ["Equals", "NotEquals", "In", "NotIn", "GreaterThan", "LessThan", "Contains"]
    context = F.create_map(
        F.lit("type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"),
        F.lit("user"), F.concat(F.lit("user_"), "user_id"),
    )
    fields = F.array(*[F.lit(v) for v in ("type", "type", "type", "type", "value", "value", "user")])
    values = F.array(*[F.lit(v) for v in ("click", "view", None, None, "30", "30", "_1")])
    which = (n % 7 + 1).cast("int")
    field = F.when(n % 11 == 0, "absent").otherwise(F.element_at(fields, which))
    condition = F.struct(
        field.alias("field"), F.element_at(F.array(*[F.lit(o) for o in ops]), which).alias("op"),
        F.element_at(values, which).alias("value"),
        F.when(n % 7 == 2, F.array(F.lit("click"), F.lit("error")))
        .when((n % 7 == 3) & (n % 2 == 0), F.array(F.lit("view"))).alias("values"),
    )
    df = events.select("event_id", context.alias("context"), F.array(condition).alias("conditions"))
    return access.eval_conditions(df).select("event_id", "holds")


_CONDITION_SQL = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN false
    WHEN event_id % 7 = 0 THEN event_type = 'click' WHEN event_id % 7 = 1 THEN event_type <> 'view'
    WHEN event_id % 7 = 2 THEN event_type IN ('click', 'error')
    WHEN event_id % 7 = 3 THEN event_id % 2 = 1 OR event_type <> 'view'
    WHEN event_id % 7 = 4 THEN value > 30 WHEN event_id % 7 = 5 THEN value < 30
    ELSE contains('user_' || user_id, '_1') END AS holds FROM events"""


# ------------------------------------------------------------------- roles


def _roles(spark, sf_dir):
    """Suppliers as roles: a binary tree with a few cycles; parts of a resource tree as permissions."""
    s = F.col("s_suppkey")
    role = lambda k: F.concat(F.lit("role_"), k.cast("string"))
    half = F.floor(s / 2)
    cycle = F.when(s % 16 == 1, role(s + 2)).when(s % 16 == 3, role(s - 2))
    parents = F.filter(F.array(F.when(s > 0, role(half)), cycle), lambda r: r.isNotNull())
    n = F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        role(s).alias("role"),
        F.array(
            F.when(s % 2 == 0, F.concat(F.lit("read:res_"), n)).otherwise(F.concat(F.lit("write:res_"), n)),
            F.when(s % 31 == 7, "read:*").when(s % 31 == 9, "*:res_3").when(s % 31 == 11, "admin:system").otherwise("list:res_0"),
        ).alias("permissions"),
        parents.alias("inherits_from"),
    )


def _user_roles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    roles = table(spark, sf_dir, "supplier").select("s_suppkey")
    return c.join(roles, F.col("c_custkey") == F.col("s_suppkey") * 3 + 1).select(
        F.concat(F.lit("user_"), "c_custkey").alias("user_id"), F.concat(F.lit("role_"), "s_suppkey").alias("role")
    )


_ROLES_SQL = """roles AS (SELECT s_suppkey AS s, 'role_' || s_suppkey AS role,
        [CASE WHEN s_suppkey % 2 = 0 THEN 'read:res_' || s_nationkey ELSE 'write:res_' || s_nationkey END,
         CASE s_suppkey % 31 WHEN 7 THEN 'read:*' WHEN 9 THEN '*:res_3' WHEN 11 THEN 'admin:system' ELSE 'list:res_0' END
        ] AS permissions FROM supplier),
    edges AS (SELECT s AS child, s // 2 AS parent FROM roles WHERE s > 0
        UNION SELECT s, s + 2 FROM roles WHERE s % 16 = 1 UNION SELECT s, s - 2 FROM roles WHERE s % 16 = 3),
    closure AS (SELECT s AS child, s AS anc FROM roles
        UNION SELECT closure.child, edges.parent FROM closure JOIN edges ON edges.child = closure.anc
            JOIN roles ON roles.s = edges.parent),
    user_roles AS (SELECT 'user_' || c_custkey AS user_id, s_suppkey AS s FROM customer JOIN supplier ON c_custkey = s_suppkey * 3 + 1),
    perms AS (SELECT DISTINCT user_id, unnest(permissions) AS permission FROM user_roles
        JOIN closure ON closure.child = user_roles.s JOIN roles ON roles.s = closure.anc)"""


def role_permissions(spark, sf_dir):
    return access.effective_permissions(_user_roles(spark, sf_dir), _roles(spark, sf_dir))


def authorize(spark, sf_dir):
    perms = role_permissions(spark, sf_dir)
    n = F.col("event_id")
    level = F.element_at(F.array(*[F.lit(v) for v in ("Public", "Internal", "Confidential", "Restricted")]), (n % 4 + 1).cast("int"))
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(n % 50 != 0, F.concat(F.lit("user_"), F.col("user_id"))).alias("user_id"),
        F.when(n % 3 == 0, "read").when(n % 3 == 1, "write").otherwise("list").alias("action"),
        F.concat(F.lit("res_"), n % 25).alias("resource"),
        F.hour("ts").alias("hour"), F.concat(F.lit("t"), n % 2).alias("tenant_id"), level.alias("security_level"),
    )
    condition = lambda kind, start=None, end=None, tenant=None, lv=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(start).cast("int").alias("start_hour"), F.lit(end).cast("int").alias("end_hour"),
        F.lit(tenant).cast("string").alias("tenant_id"), F.lit(lv).cast("string").alias("level"),
    )
    key = F.col("n_nationkey")
    named = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("read:res_"), key).alias("name"),
        F.when(key % 4 == 0, F.array(condition("time_of_day", 8, 18)))
        .when(key % 4 == 1, F.array(condition("tenant", tenant="t1"), condition("minimum_level", lv="confidential")))
        .when(key % 4 == 2, F.array(condition("ip_range")))
        .otherwise(F.array().cast("array<struct<kind:string,start_hour:int,end_hour:int,tenant_id:string,level:string>>"))
        .alias("conditions"),
    )
    admin = table(spark, sf_dir, "region").filter(F.col("r_regionkey") == 0).select(
        F.lit("admin:system").alias("name"), F.array(condition("time_of_day", 8, 18)).alias("conditions")
    )
    return access.authorize(requests, perms, named.unionByName(admin))


_AUTHORIZE_SQL = f"""WITH RECURSIVE {_ROLES_SQL},
    q AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 'anonymous' ELSE 'user_' || user_id END AS user_id,
        CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'list' END AS action,
        event_id % 25 AS res, hour(ts) AS h, event_id % 2 AS tenant, event_id % 4 AS lv FROM events),
    hit AS (SELECT q.*, CASE
        WHEN EXISTS (FROM perms p WHERE p.user_id = q.user_id AND p.permission = q.action || ':res_' || q.res) THEN q.action || ':res_' || q.res
        WHEN EXISTS (FROM perms p WHERE p.user_id = q.user_id AND p.permission = q.action || ':*') THEN q.action || ':*'
        WHEN EXISTS (FROM perms p WHERE p.user_id = q.user_id AND p.permission = '*:res_' || q.res) THEN '*:res_' || q.res
        WHEN EXISTS (FROM perms p WHERE p.user_id = q.user_id AND p.permission = 'admin:system') THEN 'admin:system' END AS matched FROM q)
    SELECT id, CASE WHEN matched IS NULL THEN false WHEN matched = 'admin:system' THEN h BETWEEN 8 AND 18
        WHEN matched = 'read:res_' || res THEN CASE res % 4 WHEN 0 THEN h BETWEEN 8 AND 18
            WHEN 1 THEN tenant = 1 AND lv >= 2 WHEN 2 THEN false ELSE true END
        ELSE true END AS granted, matched FROM hit"""


def assign_revoke(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    changes = orders.select(
        k.alias("seq"),
        F.concat(F.lit("user_"), "o_custkey").alias("user_id"),
        F.when(k % 10 == 9, F.concat(F.lit("ghost_"), k % 3)).otherwise(F.concat(F.lit("role_"), F.floor(F.col("o_custkey") / 3) + k % 2)).alias("role"),
        F.when(k % 3 == 0, "revoke").otherwise("assign").alias("op"),
    )
    new, rejected = access.apply_role_changes(_user_roles(spark, sf_dir), changes, _roles(spark, sf_dir))
    return new.withColumn("state", F.lit("held")).unionByName(
        rejected.select("user_id", "role", F.lit("rejected").alias("state")).distinct()
    )


_CHANGES_SQL = f"""WITH RECURSIVE {_ROLES_SQL},
    ch AS (SELECT o_orderkey AS seq, 'user_' || o_custkey AS user_id,
        CASE WHEN o_orderkey % 10 = 9 THEN 'ghost_' || (o_orderkey % 3) ELSE 'role_' || (o_custkey // 3 + o_orderkey % 2) END AS role,
        CASE WHEN o_orderkey % 3 = 0 THEN 'revoke' ELSE 'assign' END AS op FROM orders),
    bad AS (SELECT * FROM ch WHERE op = 'assign' AND role NOT IN (SELECT role FROM roles)),
    last AS (SELECT user_id, role, arg_max(op, seq) AS op FROM ch WHERE seq NOT IN (SELECT seq FROM bad) GROUP BY 1, 2)
    SELECT user_id, 'role_' || s AS role, 'held' AS state FROM user_roles u
        WHERE NOT EXISTS (FROM last l WHERE l.user_id = u.user_id AND l.role = 'role_' || u.s)
    UNION ALL SELECT user_id, role, 'held' FROM last WHERE op = 'assign'
    UNION ALL SELECT DISTINCT user_id, role, 'rejected' FROM bad"""


# --------------------------------------------------------------- workflows


def _steps(spark, sf_dir):
    """Orders as workflows, line numbers as steps that depend on earlier (sometimes later) ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_returnflag").alias("f")
    )
    n = F.col("l_linenumber")
    step = lambda k: F.concat(F.lit("s"), k.cast("string"))
    deps = F.filter(
        F.array(
            F.when((n > 1) & (F.col("q") > 25), step(n - 1)),
            F.when((n > 2) & (F.col("d") > 0.07), step(n - 2)),
            F.when((F.col("f") == "R") & (n == 2), step(n + 1)),
        ),
        lambda c: c.isNotNull(),
    )
    return lines.select(
        F.col("l_orderkey").alias("workflow_id"), step(n).alias("step_id"), deps.alias("depends_on"),
        (F.col("q") > 40).alias("continue_on_error"), "q", "d", "f", n.alias("n"),
    )


_STEPS_SQL = """lines AS (SELECT l_orderkey AS workflow_id, l_linenumber AS n, min(l_quantity) AS q, min(l_discount) AS d,
        min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
    steps AS (SELECT *, 's' || n AS step_id, list_filter([CASE WHEN n > 1 AND q > 25 THEN 's' || (n - 1) END,
        CASE WHEN n > 2 AND d > 0.07 THEN 's' || (n - 2) END,
        CASE WHEN f = 'R' AND n = 2 THEN 's' || (n + 1) END], lambda x: x IS NOT NULL) AS deps FROM lines)"""


def duplicate_step_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return workflow.duplicate_steps(
        lines.select(F.col("l_orderkey").alias("workflow_id"), F.concat(F.lit("s"), "l_linenumber").alias("step_id"))
    )


def _results(spark, sf_dir):
    return _steps(spark, sf_dir).select(
        "workflow_id", "step_id", F.when(F.col("d") < 0.04, "Failed").otherwise("Success").alias("status")
    )


def _forward(spark, sf_dir):
    """The same steps without the backward edges, so that every step gets its turn."""
    return _steps(spark, sf_dir).withColumn(
        "depends_on", F.filter("depends_on", lambda s: F.substring(s, 2, 9).cast("int") < F.col("n"))
    )


def skip_propagation(spark, sf_dir):
    return workflow.propagate_status(_forward(spark, sf_dir), _results(spark, sf_dir))


_SKIP_SQL = f"""WITH RECURSIVE {_STEPS_SQL},
    walk AS (SELECT DISTINCT workflow_id, 0 AS k, CAST([] AS VARCHAR[]) AS failing, CAST([] AS VARCHAR[]) AS seen FROM steps
      UNION ALL
      SELECT w.workflow_id, w.k + 1,
        CASE WHEN s.n IS NOT NULL AND s.d < 0.04 AND (s.q > 40 OR NOT list_has_any(list_filter(s.deps, lambda x: x <> 's' || (s.n + 1)), w.failing))
            THEN list_append(w.failing, 's' || (w.k + 1)) ELSE w.failing END,
        CASE WHEN s.n IS NOT NULL AND s.q <= 40 AND list_has_any(list_filter(s.deps, lambda x: x <> 's' || (s.n + 1)), w.failing)
            THEN list_append(w.seen, 's' || (w.k + 1)) ELSE w.seen END
      FROM walk w LEFT JOIN steps s ON s.workflow_id = w.workflow_id AND s.n = w.k + 1 WHERE w.k < 7)
    SELECT s.workflow_id, s.step_id, CASE WHEN list_contains(w.seen, s.step_id) THEN 'Skipped'
        WHEN s.d < 0.04 THEN 'Failed' ELSE 'Success' END AS status
    FROM steps s JOIN walk w ON w.workflow_id = s.workflow_id AND w.k = 7"""


def workflow_status(spark, sf_dir):
    """Order lines as step results; an order's date gives each step its length."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber"), "l_returnflag", "l_quantity", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    results = lines.join(orders, "o_orderkey").select(
        F.col("o_orderkey").alias("workflow_id"),
        F.when((F.col("l_returnflag") == "R") & (F.col("o_orderstatus") == "F"), "Failed")
        .when(F.col("l_linestatus") == "O", "Skipped")
        .otherwise("Success")
        .alias("status"),
        F.col("l_quantity").cast("bigint").alias("duration_ms"),
    )
    return workflow.workflow_status(results)


def _safety_steps(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    k = F.col("l_partkey")
    kind = F.element_at(F.array(*[F.lit(v) for v in ("Command", "DeleteFile", "Http", "CreateFile")]), (k % 4 + 1).cast("int"))
    return lines.select(
        F.col("l_orderkey").alias("workflow_id"), F.concat(F.lit("s"), n).alias("step_id"), kind.alias("step_type"),
        F.when(k % 4 == 0, F.when(k % 40 == 0, "rm -rf /tmp/x").when(k % 40 == 4, "SUDO ls").when(k % 40 == 8, "sudo ls").otherwise("echo hi")).alias("command"),
        F.when(k % 4 == 1, F.when(k % 60 == 1, "/etc/passwd").otherwise("/data/a")).when(k % 4 == 3, "/usr/x").alias("path"),
        F.when(k % 4 == 2, F.when(k % 12 == 2, "http://a.example").otherwise("https://a.example")).alias("url"),
        F.when(F.col("l_quantity") > 2, F.lit(30)).alias("timeout_seconds"),
    )


def safety_risk(spark, sf_dir):
    steps = _safety_steps(spark, sf_dir)
    out = None
    for mode in ("permissive", "standard", "strict"):
        part = workflow.safety_risk(steps, mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def _like_any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SAFETY_SQL = f"""WITH st AS (SELECT l_orderkey AS workflow_id,
        ['Command', 'DeleteFile', 'Http', 'CreateFile'][l_partkey % 4 + 1] AS kind,
        CASE WHEN l_partkey % 4 = 0 THEN CASE l_partkey % 40 WHEN 0 THEN 'rm -rf /tmp/x' WHEN 4 THEN 'SUDO ls'
            WHEN 8 THEN 'sudo ls' ELSE 'echo hi' END END AS command,
        CASE WHEN l_partkey % 4 = 1 THEN CASE WHEN l_partkey % 60 = 1 THEN '/etc/passwd' ELSE '/data/a' END
             WHEN l_partkey % 4 = 3 THEN '/usr/x' END AS path,
        CASE WHEN l_partkey % 4 = 2 THEN CASE WHEN l_partkey % 12 = 2 THEN 'http://a.example' ELSE 'https://a.example' END END AS url,
        l_quantity > 2 AS timed FROM lineitem),
    g AS (SELECT workflow_id, count(*) AS steps, bool_or(kind = 'Command') AS has_command,
        coalesce(bool_or(contains(command, 'rm -r')), false) AS rm, coalesce(bool_or(contains(command, 'sudo')), false) AS su,
        bool_or(NOT timed) AS untimed, count_if(kind = 'Command' AND {_like_any('lower(command)', RISKY_COMMAND_TEXT)}) AS cmd,
        count_if(kind = 'DeleteFile' AND ({' OR '.join(f"starts_with(path, '{p}')" for p in UNDELETABLE_PATHS)})) AS del,
        count_if(kind = 'Http' AND NOT starts_with(url, 'https://')) AS web, count_if(NOT timed) AS missing FROM st GROUP BY 1),
    m AS (SELECT g.*, mode, CASE mode WHEN 'strict' THEN missing ELSE 0 END AS info,
        CAST(has_command AND rm AS INT) AS r1, CAST(has_command AND su AS INT) AS r2, CAST(untimed AS INT) AS r3
        FROM g, (VALUES ('permissive'), ('standard'), ('strict')) t(mode)),
    z AS (SELECT workflow_id, mode, steps, CAST(r1 + r2 + r3 + cmd + del + web + info AS BIGINT) AS issues,
        CAST(r1 + r2 + cmd + del AS BIGINT) AS critical_issues,
        CAST(100 * r1 + 100 * r2 + 10 * r3 + 30 * cmd + 50 * del + 15 * web + 5 * info AS BIGINT) AS risk_score FROM m)
    SELECT *, CASE mode WHEN 'permissive' THEN risk_score < 80 WHEN 'standard' THEN risk_score < 50
        ELSE risk_score < 20 AND critical_issues = 0 END AS is_safe FROM z"""


QUERIES = {
    "brute_force": brute_force,
    "rate_abuse": rate_abuse,
    "exfiltration": exfiltration,
    "threat_patterns": threat_patterns,
    "injection_scan": injection_scan,
    "injection_scan_text": sql_injection_text,
    "baseline_anomaly": baseline_anomaly,
    "bad_ip": bad_ip,
    "geo_distance": geo_distance,
    "client_ip": client_ip,
    "rate_decision": rate_decision,
    "policy_decide": lambda s, d: access.policy_decide(_requests(s, d), _rules(s, d)),
    "policy_conditions": policy_conditions,
    "policy_conflicts": lambda s, d: access.policy_conflicts(_rules(s, d)),
    "role_permissions": role_permissions,
    "authorize": authorize,
    "assign_revoke": assign_revoke,
    "missing_dependency": lambda s, d: workflow.missing_dependencies(_steps(s, d)),
    "duplicate_step_ids": duplicate_step_ids,
    "dag_levels": lambda s, d: workflow.dag_levels(_steps(s, d)),
    "skip_propagation": skip_propagation,
    "workflow_status": workflow_status,
    "safety_risk": safety_risk,
}

ORACLE = {
    "brute_force": _WINDOWED_SQL + "SELECT id, source, attempts FROM b WHERE attempts >= 3",
    "rate_abuse": _WINDOWED_SQL + "SELECT id, source, requests FROM r WHERE requests > 5",
    "exfiltration": _WINDOWED_SQL
    + f"""SELECT source, strftime(make_timestamp(slot * 21600000000), '{SQL_STAMP}') AS slot,
        round(total_bytes, 4) AS total_bytes FROM x""",
    "threat_patterns": _WINDOWED_SQL
    + """SELECT source, 'brute_force_login' AS pattern, 'High' AS severity, count(*) AS detections,
            CAST(max(attempts) AS DOUBLE) AS peak FROM b WHERE attempts >= 3 GROUP BY 1
        UNION ALL SELECT source, 'rate_limit_abuse', 'Medium', count(*), max(requests) FROM r WHERE requests > 5 GROUP BY 1
        UNION ALL SELECT source, 'data_exfiltration', 'High', count(*), round(max(total_bytes), 4) FROM x GROUP BY 1""",
    "injection_scan": f"""WITH h AS (SELECT page_id, {_scan_sql("url || ' ' || html")} AS hit FROM pages)
        SELECT page_id, split_part(hit, '|', 1) AS threat_type,
        CASE WHEN hit LIKE 'sql%' THEN 'Critical' ELSE 'High' END AS severity,
        CAST(CASE WHEN hit LIKE 'sql%' THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence,
        substr(hit, strpos(hit, '|') + 1) AS matched_pattern FROM h WHERE hit IS NOT NULL""",
    "injection_scan_text": f"""WITH q AS (SELECT 'd' || doc_id AS request_id, '/doc/' || doc_id AS uri, text AS body FROM documents
        UNION ALL SELECT 'e' || event_id, '/event/' || event_id, CASE event_id % 17
            WHEN 0 THEN 'username=user_' || user_id || ''' OR ''1''=''1' WHEN 1 THEN 'q=1 UNION  SELECT ' || value
            WHEN 2 THEN 'x=1; Drop Table t' WHEN 3 THEN '<IFRAME a=1 SRC=' || value || '>'
            WHEN 4 THEN '<a onclick =go()>' WHEN 5 THEN NULL ELSE props END FROM events),
        h AS (SELECT request_id, {_scan_sql("(uri || ' ' || coalesce(body, ''))")} AS hit FROM q)
        SELECT request_id, split_part(hit, '|', 1) AS threat_type, substr(hit, strpos(hit, '|') + 1) AS matched_pattern
        FROM h WHERE hit IS NOT NULL""",
    "baseline_anomaly": """WITH a AS (SELECT event_id, user_id, user_id % 50 + CASE WHEN event_id % 7 = 0 THEN 20.0 ELSE 0.5 END AS lat,
            user_id % 60 AS lon, event_id % 4 AS agent FROM events WHERE user_id % 3 <> 0),
        k AS (SELECT *, sqrt(power(lat - user_id % 50, 2) + power(lon - user_id % 60, 2)) * 111 > 1000
            AND sqrt(power(lat - user_id % 50 - 1, 2) + power(lon - user_id % 60 - 2, 2)) * 111 > 1000 AS far FROM a)
        SELECT event_id, user_id, CASE WHEN far THEN 'unusual_location' ELSE 'unusual_user_agent' END AS threat_type,
        CASE WHEN far THEN 'Medium' ELSE 'Low' END AS severity,
        CAST(CASE WHEN far THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM k WHERE far OR agent = 3""",
    "bad_ip": """SELECT event_id AS id, user_id AS source, event_type FROM events
        WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 150)""",
    "geo_distance": """SELECT event_id, round(sqrt(power(user_id % 50 + CASE WHEN event_id % 7 = 0 THEN 20.0 ELSE 0.5 END - user_id, 2)
        + power(user_id % 60 - 10.0, 2)) * 111.0, 6) AS km FROM events""",
    "client_ip": """SELECT event_id, coalesce(CASE event_id % 5 WHEN 0 THEN '10.1.' || (event_id % 256) || '.7'
        WHEN 2 THEN '2001:db8::' || (event_id % 100) END,
        CASE WHEN event_id % 3 = 0 AND event_id % 300 < 256 THEN '8.8.8.' || (event_id % 300) END) AS ip FROM events""",
    "rate_decision": _RATE_SQL,
    "policy_decide": f"""WITH {_RULES_SQL},
        q AS (SELECT event_id AS id, event_type || ':res_' || (event_id % 20) AS action, hour(ts) AS h, event_id % 6 AS region FROM events),
        m AS (SELECT q.id, q.action, rule_id, effect, row_number() OVER (PARTITION BY q.id ORDER BY priority DESC, rule_id) AS rn
            FROM q JOIN (SELECT *, unnest(actions) AS pat FROM rules) u
            ON (pat = '*' OR pat = q.action OR (pat LIKE '%*' AND starts_with(q.action, rtrim(pat, '*'))))
            AND (n % 3 = 0 OR (n % 3 = 1 AND q.region = r) OR (n % 3 = 2 AND q.h > n % 12)))
        SELECT q.id, q.action, coalesce(effect, 'Deny') = 'Allow' AS allowed, rule_id FROM q LEFT JOIN m ON m.id = q.id AND rn = 1""",
    "policy_conditions": _CONDITION_SQL,
    "policy_conflicts": f"""WITH {_RULES_SQL}, u AS (SELECT rule_id, priority, unnest(actions) AS pat FROM rules)
        SELECT DISTINCT a.rule_id AS rule_a, b.rule_id AS rule_b, a.priority FROM u a JOIN u b ON a.priority = b.priority
        AND a.rule_id < b.rule_id AND (a.pat = b.pat OR a.pat = '*' OR b.pat = '*'
            OR (a.pat LIKE '%*' AND starts_with(b.pat, rtrim(a.pat, '*')))
            OR (b.pat LIKE '%*' AND starts_with(a.pat, rtrim(b.pat, '*'))))""",
    "role_permissions": f"WITH RECURSIVE {_ROLES_SQL} SELECT user_id, permission FROM perms",
    "authorize": _AUTHORIZE_SQL,
    "assign_revoke": _CHANGES_SQL,
    "missing_dependency": f"""WITH {_STEPS_SQL}, u AS (SELECT workflow_id, step_id, unnest(deps) AS depends_on FROM steps)
        SELECT DISTINCT * FROM u WHERE NOT EXISTS (FROM steps s WHERE s.workflow_id = u.workflow_id AND s.step_id = u.depends_on)""",
    "duplicate_step_ids": """SELECT l_orderkey AS workflow_id, 's' || l_linenumber AS step_id, count(*) AS copies
        FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "dag_levels": f"""WITH RECURSIVE {_STEPS_SQL},
        w AS (SELECT workflow_id, list({{'s': step_id, 'deps': deps}}) AS all_steps FROM steps GROUP BY 1),
        rounds AS (SELECT workflow_id, all_steps, 0 AS k, CAST([] AS VARCHAR[]) AS done,
            list_transform(list_filter(all_steps, lambda x: len(x.deps) = 0), lambda x: x.s) AS fresh FROM w
          UNION ALL
          SELECT workflow_id, all_steps, k + 1, list_concat(done, fresh),
            list_transform(list_filter(all_steps, lambda x: NOT list_contains(list_concat(done, fresh), x.s)
                AND list_has_all(list_concat(done, fresh), x.deps)), lambda x: x.s)
          FROM rounds WHERE len(fresh) > 0),
        lv AS (SELECT workflow_id, unnest(fresh) AS step_id, k AS level FROM rounds)
        SELECT s.workflow_id, s.step_id, level FROM steps s LEFT JOIN lv ON lv.workflow_id = s.workflow_id AND lv.step_id = s.step_id""",
    "skip_propagation": _SKIP_SQL,
    "workflow_status": """SELECT l_orderkey AS workflow_id, CASE WHEN bool_or(s = 'Failed') THEN 'Failed'
            WHEN bool_and(s = 'Skipped') THEN 'Cancelled' ELSE 'Completed' END AS status, count(*) AS steps,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_duration_ms FROM (
        SELECT *, CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'Failed' WHEN l_linestatus = 'O' THEN 'Skipped'
            ELSE 'Success' END AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""",
    "safety_risk": _SAFETY_SQL,
}
