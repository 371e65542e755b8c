"""Memory, metric, template, schedule and encryption queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.fixed_values import MODEL_PRICES
from tidemark.functions import encryption
from tidemark.operators import memory, metrics, schedule, transforms
from tidemark.plans.views import AUDIT_SQL, SQL_STAMP, audit_view, stamp
from tidemark.session import table
from tidemark.sources import html

NOW = dt.datetime(2024, 1, 20, 6, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-20 06:00:00'"
AUDIT = f"WITH audit AS ({AUDIT_SQL}) "

# ------------------------------------------------------------------ memory


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    expires = F.when(k % 5 == 0, None).when(k % 5 == 1, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts") + F.expr("INTERVAL 12 DAYS"))
    return e.select(F.concat(F.lit("k"), k).alias("key"), F.col("props").alias("value"), F.col("ts").alias("created_at"), expires.alias("expires_at"))


_ENTRIES_SQL = """WITH m AS (SELECT 'k' || event_id AS key, props AS value, ts AS created_at, CASE event_id % 5 WHEN 0 THEN NULL
    WHEN 1 THEN ts + INTERVAL 1 DAY ELSE ts + INTERVAL 12 DAYS END AS expires_at FROM events) """
_LIVE = f"(expires_at IS NULL OR {NOW_SQL} <= expires_at)"


def evict_oldest(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return memory.evict(entries, 500, NOW).select("key", stamp("created_at").alias("created_at"))


def conversation_stats(spark, sf_dir):
    out = memory.conversation_stats(table(spark, sf_dir, "conversations"))
    roles = F.array_join(F.transform(F.map_entries("role_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("conv_id", "total_messages", "total_characters", "participants", roles.alias("role_counts"))


def transcript(spark, sf_dir):
    out = memory.transcript(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "messages", F.md5("transcript").alias("transcript_md5"))


def last_n_messages(spark, sf_dir):
    return memory.last_messages(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


def session_summary(spark, sf_dir):
    sessions = audit_view(spark, sf_dir).filter(F.col("session_id").isNotNull())
    out = memory.session_summary(sessions)
    return out.select("session_id", stamp("created_at").alias("created_at"), stamp("last_activity").alias("last_activity"), "message_count")


def session_expiry(spark, sf_dir):
    rows = audit_view(spark, sf_dir).filter(F.col("session_id").isNotNull()).withColumn(
        "expires_at", F.when(F.col("user_id") % 4 != 0, F.col("timestamp") + F.expr("INTERVAL 3 DAYS"))
    )
    out = memory.active_sessions(rows, NOW, idle_hours=120)
    return out.select("session_id", stamp("last_activity").alias("last_activity"), "active")


def _cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return memory.cache_store(docs.filter(F.col("lang") == "en").select(F.col("text").alias("prompt"), F.md5("text").alias("result")))


def prompt_cache(spark, sf_dir):
    """Documents against a cache filled from the English ones, then with the misses stored."""
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    cache = _cache(spark, sf_dir)
    hits, misses = memory.cache_lookup(prompts, cache)
    grown = memory.cache_store(misses.select("prompt", F.upper(F.md5("prompt")).alias("result")), cache)
    again, still = memory.cache_lookup(prompts, grown)
    return again.select("doc_id", F.lit("hit").alias("state"), "result").unionByName(
        still.select("doc_id", F.lit("miss").alias("state"), F.lit(None).cast("string").alias("result"))
    )


# ----------------------------------------------------------------- metrics


def benchmark_stats(spark, sf_dir):
    out = metrics.benchmark_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    r = lambda c, n=4: F.round(c, n).alias(c)
    return out.select("l_returnflag", "l_linestatus", "iterations", r("total", 2), r("mean"), r("median"), r("stdev"), "min", "max", "p95", "p99")


def _run(spark, sf_dir, value, flag):
    """Mean of a measure per ship mode as one benchmark run; some operations skipped, failed or absent."""
    lines = table(spark, sf_dir, "lineitem").withColumn("operation", F.concat(F.lit("op_"), F.col("l_suppkey") % 12))
    k = F.regexp_extract("operation", r"(\d+)", 1).cast("int")
    return (
        lines.groupBy("operation").agg(F.avg(value).alias("mean_ms"))
        .withColumn("skipped", k == flag)
        .withColumn("error", F.when(k == flag + 1, "boom"))
        .filter(k != flag + 2)
        .withColumn("mean_ms", F.when(k != flag + 3, F.col("mean_ms")).otherwise(0.0))
    )


def benchmark_compare(spark, sf_dir):
    out = metrics.compare_runs(_run(spark, sf_dir, "l_quantity", 0), _run(spark, sf_dir, "l_discount", 6))
    mean = metrics.mean_speedup(out)
    rows = out.select("operation", F.round("a_mean", 6).alias("a_mean"), F.round("b_mean", 6).alias("b_mean"), "status", F.round("speedup", 4).alias("speedup"))
    total = mean.select(
        F.lit("mean").alias("operation"), F.lit(None).cast("double").alias("a_mean"), F.lit(None).cast("double").alias("b_mean"),
        F.lit("total").alias("status"), F.round("mean_speedup", 4).alias("speedup"),
    )
    return rows.unionByName(total)


_RUN_SQL = """l AS (SELECT 'op_' || (l_suppkey % 12) AS operation, l_suppkey % 12 AS k, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2),
    a AS (SELECT operation, CASE WHEN k = 3 THEN 0.0 ELSE q END AS a_mean, k = 0 AS skipped, k = 1 AS failed FROM l WHERE k <> 2),
    b AS (SELECT operation, CASE WHEN k = 9 THEN 0.0 ELSE d END AS b_mean, k = 6 AS skipped, k = 7 AS failed FROM l WHERE k <> 8),
    c AS (SELECT operation, a_mean, b_mean, CASE WHEN coalesce(a.skipped, false) OR coalesce(b.skipped, false) THEN 'skipped'
        WHEN coalesce(a.failed, false) OR coalesce(b.failed, false) THEN 'error'
        WHEN coalesce(a_mean, 0) > 0 AND coalesce(b_mean, 0) > 0 THEN 'compared' ELSE 'missing' END AS status FROM a FULL JOIN b USING (operation))"""


def performance_gains(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sides = li.groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("ours_time"), F.avg("l_extendedprice").alias("other_memory"), F.max("l_extendedprice").alias("ours_memory"),
        F.max("l_quantity").alias("other_time"), F.avg("l_discount").alias("ours_cpu"), F.avg("l_tax").alias("other_cpu"),
        F.count("*").alias("ours_throughput"), F.count_if(F.col("l_returnflag") == "A").alias("other_throughput"),
        F.min("l_tax").alias("ours_errors"), F.max("l_tax").alias("other_errors"),
    )
    out = metrics.performance_gains(sides)
    names = ["speed_improvement_percent", "memory_reduction_percent", "cpu_efficiency_gain", "throughput_multiplier", "reliability_improvement"]
    return out.select("l_suppkey", *[F.round(n, 4).alias(n) for n in names])


def _kinds(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "workflow").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "purchase", "model").when(
        F.col("event_type") == "signup", "memory").otherwise("error")
    return table(spark, sf_dir, "events").select(kind.alias("kind"), F.col("value").cast("bigint").alias("duration_ms"))


_KINDS_SQL = """WITH k AS (SELECT CASE event_type WHEN 'click' THEN 'workflow' WHEN 'view' THEN 'tool' WHEN 'purchase' THEN 'model'
    WHEN 'signup' THEN 'memory' ELSE 'error' END AS kind, CAST(trunc(value) AS BIGINT) AS duration_ms FROM events) """


def _modules(spark, sf_dir):
    k = F.col("p_partkey")
    severity = F.element_at(F.array(*[F.lit(v) for v in ("Low", "Medium", "High", "Critical")]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("module"), "p_brand",
        F.when(k % 50 == 0, "errors").when(k % 7 == 0, "warnings").otherwise("clean").alias("status"),
        F.when(F.col("p_size") > 45, F.col("p_size") - 45).otherwise(0).alias("tests_failed"),
        (F.col("p_retailprice") / 11.0).alias("coverage"),
        F.when(k % 9 == 0, F.array(F.lit("Low"), severity)).otherwise(F.array().cast("array<string>")).alias("issues"),
    )


_MODULES_SQL = """WITH m AS (SELECT p_partkey AS module, CASE WHEN p_partkey % 50 = 0 THEN 'errors' ELSE 'clean' END AS status,
    CASE WHEN p_size > 45 THEN p_size - 45 ELSE 0 END AS tests_failed, p_retailprice / 11.0 AS coverage,
    p_partkey % 9 = 0 AND p_partkey % 4 = 3 AS critical, p_partkey % 9 = 0 AND p_partkey % 4 = 2 AS high FROM part) """


def build_health(spark, sf_dir):
    whole = metrics.build_health(_modules(spark, sf_dir)).withColumn("scope", F.lit("all"))
    good = _modules(spark, sf_dir).filter((F.col("status") != "errors") & (F.col("tests_failed") == 0))
    return whole.unionByName(metrics.build_health(good).withColumn("scope", F.lit("built_and_tested")))


def _features(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", F.col("source").alias("category")), "doc_id").select(
        "doc_id", "category", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("available")
    )


def feature_availability(spark, sf_dir):
    features = _features(spark, sf_dir)
    out = metrics.availability(features).withColumn("percent", F.round("percent", 4))
    missing = metrics.missing_features(features).groupBy("category").agg(F.count("*").alias("missing"))
    return out.join(missing, "category", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


def _calls(spark, sf_dir):
    """Assistant turns as model calls; word counts stand for tokens, the previous turns are the prompt."""
    c = table(spark, sf_dir, "conversations")
    names = F.array(*[F.lit(m[0]) for m in MODEL_PRICES], F.lit("local-model"))
    words = F.size(F.split("text", " ")).cast("bigint")
    return c.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.element_at(names, (F.col("conv_id") % (len(MODEL_PRICES) + 1) + 1).cast("int")).alias("model"),
        ((F.col("turn") + 1) * 40).alias("prompt_tokens"), words.alias("completion_tokens"),
        F.when(words > 150, "length").otherwise("stop").alias("finish_reason"),
    )


_names_sql = "[" + ", ".join(f"'{m[0]}'" for m in MODEL_PRICES) + ", 'local-model']"
_CALLS_SQL = f"""WITH calls AS (SELECT conv_id, turn, {_names_sql}[conv_id % {len(MODEL_PRICES) + 1} + 1] AS model, (turn + 1) * 40 AS prompt_tokens,
    len(string_split(text, ' ')) AS completion_tokens, CASE WHEN len(string_split(text, ' ')) > 150 THEN 'length' ELSE 'stop' END AS finish_reason
    FROM conversations WHERE role = 'assistant'),
    prices AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{p}', CAST({i:.12f} AS DOUBLE), CAST({o:.12f} AS DOUBLE))" for m, p, i, o in MODEL_PRICES)}) t(model, provider, pin, pout)),
    costed AS (SELECT calls.*, provider, prompt_tokens * pin + completion_tokens * pout AS cost FROM calls LEFT JOIN prices USING (model)) """


def token_cost(spark, sf_dir):
    costed = metrics.token_cost(_calls(spark, sf_dir), metrics.model_prices(spark))
    return metrics.cost_totals(costed).withColumn("cost", F.round("cost", 8))


def token_cost_calls(spark, sf_dir):
    costed = metrics.token_cost(_calls(spark, sf_dir), metrics.model_prices(spark))
    return costed.select("conv_id", "turn", "model", "provider", F.round("cost", 9).alias("cost"))


# ----------------------------------------------------- templates and chains


def _vars(spark, sf_dir):
    d = F.col("doc_id")
    template = F.element_at(
        F.array(*[F.lit(t) for t in ("{lang}/{source}: {n_chars} {missing} {a b} {lang}", "{{lang}} is {x..y} {odd}", "no holes", "{text} of {doc.id}")]),
        (d % 4 + 1).cast("int"),
    )
    variables = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"),
        F.lit("odd"), F.when(d % 8 == 1, "a;b").otherwise("plain {lang}"), F.lit("text"), F.col("text"), F.lit("doc.id"), d.cast("string"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", template.alias("template"), variables.alias("vars"))


def substitute(spark, sf_dir):
    out = _vars(spark, sf_dir).select("doc_id", transforms.substitute(F.col("template"), F.col("vars")).alias("t"))
    return out.select("doc_id", F.md5("t").alias("text_md5"))


_UNSAFE_TEXT = r"""[;&|`~'"]|\$\(|\$\{|\.\./|%2e%2e|%2E%2E|%2f|%5c|<script|</script>|javascript:|data:|--|/\*|\*/"""


def prompt_format(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    template = F.lit("Item {{item}} says: {{text}} ({{item}}, {{none}})")
    out = transforms.render_prompt(template, F.create_map(F.lit("item"), F.col("item_id").cast("string"), F.lit("text"), F.col("text")))
    return b.select("item_id", out.alias("prompt"))


def template_vars(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(F.lit("Use {{lang}} and {{ source "), d, F.lit("}} with {x"), d % 3, F.lit("} "), F.left("text", F.lit(0)), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return docs.select("doc_id", F.array_join(transforms.template_vars(F.col("t")), "|").alias("names"), F.md5(transforms.double_braces(F.col("t"))).alias("doubled_md5"))


def map_reduce_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    longest = transforms.map_reduce(docs, F.char_length, lambda xs: F.coalesce(F.array_max(xs), F.lit(0)), out="longest")
    out = transforms.map_reduce(longest, lambda v: F.left(v, F.lit(3)), lambda xs: F.array_join(xs, "|"), out="heads")
    return out.select("doc_id", "longest", F.md5("heads").alias("heads_md5"))


def route(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    branches = {"en": F.concat(F.lit("en:"), "source"), "fr": F.upper("source"), "de": F.col("n_chars").cast("string")}
    with_default = transforms.route(docs, F.col("lang"), branches, F.lit("other")).withColumn("mode", F.lit("default"))
    without = transforms.route(docs, F.col("lang"), branches).withColumn("mode", F.lit("strict"))
    return with_default.unionByName(without).select("doc_id", "mode", "route", "output", "route_error")


def _stages():
    return [
        ("number", lambda c: c.try_cast("int").cast("string")),
        ("small", lambda c: F.when(c.try_cast("int") < 1500, c)),
        ("label", lambda c: F.concat(F.lit("n"), c)),
    ]


def _chained(spark, sf_dir, halt):
    d = F.col("doc_id")
    value = F.when(d % 6 == 0, "abc").otherwise(F.col("n_chars").cast("string"))
    return transforms.transform_chain(table(spark, sf_dir, "documents").select("doc_id", value.alias("v")), "v", _stages(), halt)


def transform_chain(spark, sf_dir):
    out = None
    for halt in (True, False):
        part = _chained(spark, sf_dir, halt).select("doc_id", F.lit(halt).alias("halting"), "output", F.array_join("failed_stages", ",").alias("failed_stages"))
        out = part if out is None else out.unionByName(part)
    return out


def transform_chain_counts(spark, sf_dir):
    names = [n for n, _ in _stages()]
    out = None
    for halt in (True, False):
        part = transforms.stage_counts(_chained(spark, sf_dir, halt), names, halt).withColumn("halting", F.lit(halt))
        out = part if out is None else out.unionByName(part)
    return out


def _echo(prompts: list[str]) -> list[dict]:
    """A stand-in model: the first word, exclaimed."""
    return [
        {"content": p.split(" ")[0] + "!", "prompt_tokens": len(p.split(" ")), "completion_tokens": 1,
         "finish_reason": "length" if len(p) > 2000 else "stop"}
        for p in prompts
    ]


def infer_column(spark, sf_dir):
    """Rendered prompts of all documents and benchmark items through a model, known answers from the cache."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    asked = b.unionByName(d).select("id", transforms.render_prompt(F.lit("{{t}} ?"), F.create_map(F.lit("t"), F.col("text"))).alias("prompt"))
    cache = memory.cache_store(b.select(F.concat("text", F.lit(" ?")).alias("prompt"), F.lit("cached").alias("result")))
    hits, misses = memory.cache_lookup(asked, cache)
    answered = transforms.infer(misses.select("id", "prompt"), _echo)
    return answered.select("id", F.col("response.content").alias("content"), F.col("response.prompt_tokens").alias("prompt_tokens"), F.col("response.finish_reason").alias("finish_reason")).unionByName(
        hits.select("id", F.col("result").alias("content"), F.lit(0).cast("bigint").alias("prompt_tokens"), F.lit("cache").alias("finish_reason"))
    )


def search_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        html.title(F.col("html")).alias("title"), F.col("url").alias("link"), F.left("html", F.lit(15)).alias("snippet"), F.lit("pages").alias("source"), F.col("page_id").alias("position")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("title"), F.concat(F.lit("doc/"), "doc_id").alias("link"), F.left("text", F.lit(40)).alias("snippet"), F.concat(F.lit("docs_"), "source").alias("source"), F.col("doc_id").alias("position")
    )
    return transforms.merge_results(pages, docs, cap=5).select("link", "source", "snippet", "position")


# --------------------------------------------------------------- schedules

_EXPRESSIONS = ["*/15 * * * *", "0 9-17 * * 1-5", "@daily", "30 2 1,15 * *", "5 4 * * 7", "0 0 12 * * *", "*/0 * * * *", "61 * * * *", "@never", "1 2 3",
                "0-10/5 6 * 1 *", "@weekly", "1-5,8 * * * *", "0 0 31 2 *"]
P_START, P_END = dt.datetime(2024, 1, 14, 0, 0, 0), dt.datetime(2024, 1, 16, 12, 0, 0)


def _schedules(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("schedule_id"), F.element_at(F.array(*[F.lit(e) for e in _EXPRESSIONS]), (k % len(_EXPRESSIONS) + 1).cast("int")).alias("expression")
    )


def cron_expand(spark, sf_dir):
    out = schedule.expand_schedules(_schedules(spark, sf_dir), P_START, P_END)
    return out.select("schedule_id", stamp("fire_at").alias("fire_at"))


def cron_errors(spark, sf_dir):
    return schedule.parse_schedules(_schedules(spark, sf_dir)).filter(F.col("error").isNotNull()).select("schedule_id", "error")


_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_FIRE_SQL = f"""WITH s AS (SELECT s_suppkey AS schedule_id, s_suppkey % {len(_EXPRESSIONS)} AS x FROM supplier),
    t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-14 00:00:00', TIMESTAMP '2024-01-16 11:59:00', INTERVAL 1 MINUTE)) AS fired),
    f AS (SELECT schedule_id, fired FROM s, t WHERE CASE x
        WHEN 0 THEN minute(fired) % 15 = 0 WHEN 1 THEN minute(fired) = 0 AND hour(fired) BETWEEN 9 AND 17 AND dayofweek(fired) BETWEEN 1 AND 5
        WHEN 2 THEN minute(fired) = 0 AND hour(fired) = 0 WHEN 3 THEN minute(fired) = 30 AND hour(fired) = 2 AND day(fired) IN (1, 15)
        WHEN 4 THEN minute(fired) = 5 AND hour(fired) = 4 AND dayofweek(fired) = 0 WHEN 5 THEN minute(fired) = 0 AND hour(fired) = 12
        WHEN 10 THEN minute(fired) IN (0, 5, 10) AND hour(fired) = 6 AND month(fired) = 1
        WHEN 11 THEN minute(fired) = 0 AND hour(fired) = 0 AND dayofweek(fired) = 0 ELSE false END) """


def execution_window(spark, sf_dir):
    k = F.col("schedule_id")
    fired = schedule.expand_schedules(_schedules(spark, sf_dir), P_START, P_END).withColumns(
        {
            "window_start": F.when(k % 2 == 0, "22:00").otherwise("08:30"), "window_end": F.when(k % 2 == 0, "06:15").otherwise("12:00"),
            "business_hours_only": k % 3 == 0, "max_attempts": (k % 3).cast("int"), "backoff_minutes": F.lit(10), "exponential": k % 4 < 2,
        }
    )
    kept = schedule.apply_window(fired)
    retries = schedule.retry_times(kept)
    return kept.select("schedule_id", stamp("fire_at").alias("at"), F.lit(0).alias("attempt")).unionByName(
        retries.select("schedule_id", stamp("retry_at").alias("at"), "attempt")
    )


def field_encrypt(spark, sf_dir):
    key = F.lit("0123456789abcdef").cast("binary")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sealed = encryption.encrypt_columns(c, ["c_name", "c_mktsegment"], key)
    swapped = sealed.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")))
    opened = encryption.decrypt_columns(swapped, ["c_name", "c_mktsegment"], key)
    lengths = sealed.select("c_custkey", F.char_length("c_name").alias("sealed_chars"))
    return opened.join(lengths, "c_custkey")


QUERIES = {
    "not_expired": lambda s, d: memory.not_expired(_entries(s, d), NOW).select("key", "value"),
    "memory_stats": lambda s, d: memory.memory_stats(_entries(s, d), NOW),
    "evict_oldest": evict_oldest,
    "conversation_search": lambda s, d: memory.search_messages(table(s, d, "conversations"), "THE"),
    "conversation_stats": conversation_stats,
    "last_n_messages": last_n_messages,
    "message_format": transcript,
    "session_summary": session_summary,
    "session_expiry": session_expiry,
    "prompt_cache": prompt_cache,
    "benchmark_stats": benchmark_stats,
    "benchmark_compare": benchmark_compare,
    "performance_gains": performance_gains,
    "duration_totals": lambda s, d: metrics.duration_totals(_kinds(s, d)),
    "metric_counters": lambda s, d: metrics.metric_counters(_kinds(s, d)),
    "build_health": build_health,
    "problem_modules": lambda s, d: metrics.problem_modules(_modules(s, d)).select("module"),
    "feature_availability": feature_availability,
    "token_cost": token_cost,
    "token_cost_calls": token_cost_calls,
    "token_usage": lambda s, d: metrics.token_usage(_calls(s, d)),
    "substitute": substitute,
    "prompt_format": prompt_format,
    "template_vars": template_vars,
    "map_reduce_lines": map_reduce_lines,
    "route": route,
    "transform_chain": transform_chain,
    "transform_chain_counts": transform_chain_counts,
    "infer_column": infer_column,
    "search_union": search_union,
    "cron_expand": cron_expand,
    "cron_errors": cron_errors,
    "execution_window": execution_window,
    "field_encrypt": field_encrypt,
}

_CHAIN_CASES = """WITH d AS (SELECT doc_id, n_chars, CAST(n_chars AS VARCHAR) AS v, doc_id % 6 = 0 AS bad, n_chars >= 1500 AS large FROM documents),
    r AS (SELECT doc_id, true AS halting, CASE WHEN bad OR large THEN NULL ELSE 'n' || v END AS output,
            CASE WHEN bad THEN 'number' WHEN large THEN 'small' ELSE '' END AS failed_stages FROM d
        UNION ALL SELECT doc_id, false, CASE WHEN bad THEN 'nabc' ELSE 'n' || v END,
            CASE WHEN bad THEN 'number,small' WHEN large THEN 'small' ELSE '' END FROM d) """
_SESS = AUDIT + ", s AS (SELECT * FROM audit WHERE session_id IS NOT NULL) "

ORACLE = {
    "not_expired": _ENTRIES_SQL + f"SELECT key, value FROM m WHERE {_LIVE}",
    "memory_stats": _ENTRIES_SQL
    + f"""SELECT count(*) AS total_entries, CAST(count_if({_LIVE}) AS BIGINT) AS active_entries, CAST(count_if(NOT {_LIVE}) AS BIGINT) AS expired_entries,
        CAST(sum(strlen(value)) AS BIGINT) AS total_size_bytes FROM m""",
    "evict_oldest": _ENTRIES_SQL
    + f"SELECT key, strftime(created_at, '{SQL_STAMP}') AS created_at FROM m WHERE {_LIVE} ORDER BY m.created_at DESC, key DESC LIMIT 499",
    "conversation_search": "SELECT conv_id, turn, role || ': ' || text AS line FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(role), 'the')",
    "conversation_stats": """WITH r AS (SELECT conv_id, role, count(*) AS n, sum(strlen(text)) AS b FROM conversations GROUP BY 1, 2)
        SELECT conv_id, CAST(sum(n) AS BIGINT) AS total_messages, CAST(sum(b) AS BIGINT) AS total_characters, count(*) AS participants,
        string_agg(role || '=' || n, ',' ORDER BY role) AS role_counts FROM r GROUP BY 1""",
    "last_n_messages": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "message_format": "SELECT conv_id, count(*) AS messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript_md5 FROM conversations GROUP BY 1",
    "session_summary": _SESS
    + f"SELECT session_id, strftime(min(timestamp), '{SQL_STAMP}') AS created_at, strftime(max(timestamp), '{SQL_STAMP}') AS last_activity, count(*) AS message_count FROM s GROUP BY 1",
    "session_expiry": _SESS
    + f"""SELECT session_id, strftime(max(timestamp), '{SQL_STAMP}') AS last_activity, max(timestamp) >= TIMESTAMP '2024-01-15 06:00:00'
        AND (any_value(user_id) % 4 = 0 OR max(timestamp) + INTERVAL 3 DAYS >= {NOW_SQL}) AS active FROM s GROUP BY 1""",
    "prompt_cache": """WITH c AS (SELECT DISTINCT text, md5(text) AS result FROM documents WHERE lang = 'en')
        SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN 'hit' ELSE 'miss' END AS state,
        coalesce(result, upper(md5(d.text))) AS result FROM documents d LEFT JOIN c ON c.text = d.text""",
    "benchmark_stats": """WITH g AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, list_sort(list(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus)) AS s FROM lineitem LIMIT 0),
        a AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_extendedprice) AS total, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median,
            stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS min, max(l_extendedprice) AS max, list_sort(list(l_extendedprice)) AS s FROM lineitem GROUP BY 1, 2)
        SELECT l_returnflag, l_linestatus, n AS iterations, round(total, 2) AS total, round(mean, 4) AS mean, round(median, 4) AS median, round(sd, 4) AS stdev,
        min, max, s[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, s[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99 FROM a""",
    "benchmark_compare": f"""WITH {_RUN_SQL} SELECT operation, round(a_mean, 6) AS a_mean, round(b_mean, 6) AS b_mean, status,
            round(CASE WHEN status = 'compared' THEN a_mean / b_mean END, 4) AS speedup FROM c
        UNION ALL SELECT 'mean', NULL, NULL, 'total', round(avg(a_mean / b_mean), 4) FROM c WHERE status = 'compared'""",
    "performance_gains": """WITH g AS (SELECT l_suppkey, avg(l_quantity) AS ot, max(l_quantity) AS ct, max(l_extendedprice) AS om, avg(l_extendedprice) AS cm,
            avg(l_discount) AS oc, avg(l_tax) AS cc, CAST(count(*) AS DOUBLE) AS oth, CAST(count_if(l_returnflag = 'A') AS DOUBLE) AS cth, min(l_tax) AS oe, max(l_tax) AS ce FROM lineitem GROUP BY 1)
        SELECT l_suppkey, round(greatest((ct - ot) / ct * 100.0, 0), 4) AS speed_improvement_percent, round(greatest((cm - om) / cm * 100.0, 0), 4) AS memory_reduction_percent,
        round(greatest((cc - oc) / nullif(cc, 0) * 100.0, 0), 4) AS cpu_efficiency_gain, round(oth / nullif(cth, 0), 4) AS throughput_multiplier,
        round(greatest(ce - oe, 0), 4) AS reliability_improvement FROM g""",
    "duration_totals": _KINDS_SQL
    + "SELECT "
    + ", ".join(f"CAST(coalesce(sum(CASE WHEN kind = '{k}' THEN duration_ms END), 0) AS BIGINT) AS total_{k}_time, CAST(count_if(kind = '{k}') AS BIGINT) AS {k}_operations" for k in metrics.KINDS)
    + " FROM k",
    "metric_counters": _KINDS_SQL + "SELECT kind, count(*) AS events FROM k GROUP BY 1",
    "build_health": _MODULES_SQL
    + """, x AS (SELECT 'all' AS scope, * FROM m UNION ALL SELECT 'built_and_tested', * FROM m WHERE status <> 'errors' AND tests_failed = 0),
        f AS (SELECT scope, bool_and(status <> 'errors') AS build_passing, bool_and(tests_failed = 0) AS all_tests_passing, bool_and(coverage >= 80) AS coverage_threshold_met,
            bool_and(NOT critical) AS no_critical_issues FROM x GROUP BY 1)
        SELECT *, CAST(25.0 * (CAST(build_passing AS INT) + CAST(all_tests_passing AS INT) + CAST(coverage_threshold_met AS INT) + CAST(no_critical_issues AS INT)) AS DOUBLE) AS overall_score FROM f""",
    "problem_modules": _MODULES_SQL + "SELECT module FROM m WHERE status = 'errors' OR tests_failed > 0 OR coverage < 80 OR critical OR high",
    "feature_availability": """WITH f AS (SELECT source AS category, quality = 1 AND toxic = 0 AS available FROM labels JOIN documents USING (doc_id)),
        r AS (SELECT category, 0 AS is_total, count_if(available) AS a, count(*) AS t FROM f GROUP BY 1 UNION ALL SELECT NULL, 1, count_if(available), count(*) FROM f)
        SELECT category, is_total, CAST(a AS BIGINT) AS available, t AS total, round(a * 100.0 / t, 4) AS percent,
        CAST(CASE WHEN is_total = 1 THEN 0 ELSE t - a END AS BIGINT) AS missing FROM r""",
    "token_cost": _CALLS_SQL
    + """SELECT provider, model, 0 AS level, count(*) AS calls, round(sum(cost), 8) AS cost FROM costed GROUP BY 1, 2
        UNION ALL SELECT provider, NULL, 1, count(*), round(sum(cost), 8) FROM costed GROUP BY 1
        UNION ALL SELECT NULL, NULL, 3, count(*), round(sum(cost), 8) FROM costed""",
    "token_cost_calls": _CALLS_SQL + "SELECT conv_id, turn, model, provider, round(cost, 9) AS cost FROM costed",
    "token_usage": _CALLS_SQL
    + """SELECT model, finish_reason, CAST(grouping(model, finish_reason) AS INTEGER) AS level, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
        CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens
        FROM calls GROUP BY CUBE (model, finish_reason)""",
    "substitute": f"""SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN lang || '/' || source || ': ' || n_chars || ' {{missing}} {{a b}} ' || lang
        WHEN 1 THEN '{{' || lang || '}} is {{x..y}} ' || CASE WHEN doc_id % 8 = 1 THEN '{{odd}}' ELSE 'plain {{lang}}' END
        WHEN 2 THEN 'no holes'
        ELSE CASE WHEN contains(text, chr(10)) OR contains(text, chr(13)) OR contains(text, chr(9)) OR regexp_matches(text, '{_UNSAFE_TEXT.replace(chr(39), chr(39) * 2)}')
            THEN '{{text}}' ELSE text END || ' of ' || doc_id END) AS text_md5 FROM documents""".replace("{{", "{").replace("}}", "}").replace("\\$\\{|", "\\$\\{|"),
    "prompt_format": "SELECT item_id, 'Item ' || item_id || ' says: ' || text || ' (' || item_id || ', {{none}})' AS prompt FROM benchmark",
    "template_vars": r"""WITH t AS (SELECT doc_id, 'Use {{lang}} and {{ source ' || doc_id || '}} with {x' || (doc_id % 3) || '} ' || text AS t FROM documents)
        SELECT doc_id, array_to_string(regexp_extract_all(t, '\{\{([^{}]+)\}\}', 1), '|') AS names, md5(regexp_replace(t, '\{([^{}]+)\}', '{{\1}}', 'g')) AS doubled_md5 FROM t""",
    "map_reduce_lines": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda v: v <> '') AS ls FROM documents)
        SELECT doc_id, CAST(coalesce(list_max(list_transform(ls, lambda v: length(v))), 0) AS INTEGER) AS longest,
        md5(coalesce(array_to_string(list_transform(ls, lambda v: substr(v, 1, 3)), '|'), '')) AS heads_md5 FROM l""",
    "route": """WITH r AS (SELECT *, CASE lang WHEN 'en' THEN 'en:' || source WHEN 'fr' THEN upper(source) WHEN 'de' THEN CAST(n_chars AS VARCHAR) END AS out_ FROM documents)
        SELECT doc_id, 'default' AS mode, CASE WHEN out_ IS NULL THEN 'default' ELSE lang END AS route, coalesce(out_, 'other') AS output, CAST(NULL AS VARCHAR) AS route_error FROM r
        UNION ALL SELECT doc_id, 'strict', CASE WHEN out_ IS NOT NULL THEN lang END, out_, CASE WHEN out_ IS NULL THEN 'no route for key: ' || lang END FROM r""",
    "transform_chain": _CHAIN_CASES + "SELECT doc_id, halting, output, failed_stages FROM r",
    "transform_chain_counts": _CHAIN_CASES
    + """SELECT 'number' AS stage, count_if(NOT contains(failed_stages, 'number'))::BIGINT AS succeeded, count_if(contains(failed_stages, 'number'))::BIGINT AS failed, halting FROM r GROUP BY halting
        UNION ALL SELECT 'small', count_if(failed_stages = '' )::BIGINT, count_if(contains(failed_stages, 'small'))::BIGINT, halting FROM r GROUP BY halting
        UNION ALL SELECT 'label', count_if(NOT halting OR failed_stages = '')::BIGINT, 0, halting FROM r GROUP BY halting""",
    "infer_column": """WITH q AS (SELECT 'b' || item_id AS id, text || ' ?' AS prompt FROM benchmark UNION ALL SELECT 'd' || doc_id, text || ' ?' FROM documents),
        c AS (SELECT DISTINCT text || ' ?' AS prompt FROM benchmark)
        SELECT id, CASE WHEN c.prompt IS NOT NULL THEN 'cached' ELSE string_split(q.prompt, ' ')[1] || '!' END AS content,
        CASE WHEN c.prompt IS NOT NULL THEN 0 ELSE len(string_split(q.prompt, ' ')) END AS prompt_tokens,
        CASE WHEN c.prompt IS NOT NULL THEN 'cache' WHEN length(q.prompt) > 2000 THEN 'length' ELSE 'stop' END AS finish_reason FROM q LEFT JOIN c ON c.prompt = q.prompt""",
    "search_union": """WITH u AS (SELECT url AS link, 'pages' AS source, substr(html, 1, 15) AS snippet, page_id AS position FROM pages
        UNION ALL SELECT 'doc/' || doc_id, 'docs_' || source, substr(text, 1, 40), doc_id FROM documents)
        SELECT link, source, snippet, position FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY position, link) <= 5""",
    "cron_expand": _FIRE_SQL + f"SELECT schedule_id, strftime(fired, '{SQL_STAMP}') AS fire_at FROM f",
    "cron_errors": f"""SELECT s_suppkey AS schedule_id, CASE s_suppkey % {len(_EXPRESSIONS)} WHEN 6 THEN 'invalid minute' WHEN 7 THEN 'invalid minute' WHEN 8 THEN 'unknown name'
        WHEN 9 THEN 'expected 5 or 6 fields' ELSE 'invalid minute' END AS error FROM supplier WHERE s_suppkey % {len(_EXPRESSIONS)} IN (6, 7, 8, 9, 12)""",
    "execution_window": _FIRE_SQL
    + f""", k AS (SELECT * FROM f WHERE CASE WHEN schedule_id % 2 = 0 THEN strftime(fired, '%H:%M') >= '22:00' OR strftime(fired, '%H:%M') <= '06:15'
            ELSE strftime(fired, '%H:%M') BETWEEN '08:30' AND '12:00' END
            AND (schedule_id % 3 <> 0 OR (dayofweek(fired) BETWEEN 1 AND 5 AND hour(fired) BETWEEN 9 AND 16)))
        SELECT schedule_id, strftime(fired, '{SQL_STAMP}') AS at, 0 AS attempt FROM k
        UNION ALL SELECT schedule_id, strftime(fired + to_minutes(CAST(10 * CASE WHEN schedule_id % 4 < 2 THEN power(2, a) - 1 ELSE a END AS BIGINT)), '{SQL_STAMP}'), CAST(a AS INTEGER)
            FROM k, (VALUES (1), (2)) t(a) WHERE a <= schedule_id % 3""",
    "field_encrypt": """SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment,
        CAST(4 * ceil((12 + strlen('c_name:' || c_name) + 16) / 3.0) AS INTEGER) AS sealed_chars FROM customer""",
}
