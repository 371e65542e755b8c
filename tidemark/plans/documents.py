"""Source, HTML and validation queries. Files are first written from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv

from tidemark.operators import audit as audit_op
from tidemark.operators import validation as val
from tidemark.plans.audit import AUDIT, END, PERIOD, START
from tidemark.plans.views import SQL_STAMP, audit_view, stamp
from tidemark.session import fresh_path, spread, table
from tidemark.sources import files, html

# ------------------------------------------------------------------- files


def csv_load(spark, sf_dir):
    """Orders as a ragged, header-less CSV: every fifth row lacks the last field, every seventh has one more."""
    k = F.col("o_orderkey")
    line = F.concat_ws(
        ";", k.cast("string"), F.concat(F.lit('"'), F.replace("o_orderpriority", F.lit("-"), F.lit(";")), F.lit('"')), "o_orderstatus",
        F.when(k % 5 != 0, F.col("o_custkey").cast("string")), F.when(k % 35 == 1, F.lit("extra")),
    )
    path = fresh_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select(line).write.text(path)
    return files.load_csv(spark, path, delimiter=";", has_headers=False)


def csv_header(spark, sf_dir):
    path = fresh_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True)
    return files.load_csv(spark, path)


def csv_rows_text(spark, sf_dir):
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select((n + 1).alias("row"), F.col("n_name").alias("name"), F.when(n % 6 != 0, F.col("n_regionkey")).alias("region"))
    r = F.col("r_regionkey")
    region = table(spark, sf_dir, "region").select((r + 101).alias("row"), F.col("r_name").alias("name"), r.alias("region"))
    both = nation.unionByName(region)
    rows = files.csv_as_text(both, "row")
    total = files.csv_summary(both.drop("row")).select(F.lit(0).alias("row"), F.concat_ws(" / ", "columns", "rows", "column_names").alias("text"))
    return rows.unionByName(total)


def _order_csv(spark, sf_dir):
    """One CSV text per customer over its orders; customers of every ninth have a broken row."""
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit(', ""x""'), F.lit('"')))
    lines = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    tail = F.when(F.col("o_custkey") % 9 == 0, "\nonly_one").otherwise("")
    return lines.select(F.col("o_custkey").alias("id"), F.concat(F.lit("key,status\n"), "body", tail).alias("content"))


def csv_profile(spark, sf_dir):
    out = files.csv_profile(_order_csv(spark, sf_dir))
    return out.select("id", F.array_join("headers", "|").alias("headers"), F.array_join(F.flatten("records"), "|").alias("cells"), "row_count", "valid")


def _props(spark, sf_dir):
    n = F.col("event_id")
    content = (
        F.when(n % 10 == 0, F.concat(F.lit("{broken "), "event_id"))
        .when(n % 10 == 1, F.concat(F.lit("["), n, F.lit(', "a"]')))
        .when(n % 10 == 2, F.concat(F.lit(' {"z": 1, "b": {"y": 2}, "event": '), n, F.lit("}")))
        .when(n % 10 == 3, F.lit("[]"))
        .when(n % 10 == 4, F.concat(F.lit('"text '), n, F.lit('"')))
        .when(n % 10 == 5, F.lit("[[1], null]"))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", content.alias("content"))


_PROPS_SQL = """p AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN '{broken ' || event_id WHEN 1 THEN '[' || event_id || ', "a"]'
    WHEN 2 THEN ' {"z": 1, "b": {"y": 2}, "event": ' || event_id || '}' WHEN 3 THEN '[]' WHEN 4 THEN '"text ' || event_id || '"'
    WHEN 5 THEN '[[1], null]' ELSE props END AS content FROM events)"""


def json_load(spark, sf_dir):
    out = files.load_json(_props(spark, sf_dir))
    return out.select("event_id", "valid", F.try_variant_get("payload", "$.k", "bigint").alias("k"), F.try_variant_get("payload", "$.b.y", "int").alias("y"))


def json_load_typed(spark, sf_dir):
    out = files.load_json(_props(spark, sf_dir), schema="k bigint")
    return out.select("event_id", "valid", F.col("payload.k").alias("k"))


def structured_profile(spark, sf_dir):
    out = files.profile_json(_props(spark, sf_dir))
    return out.select("event_id", "format", "root_type", "key_count", F.array_join("top_keys", ",").alias("top_keys"), "array_length", "first_element_type")


def yaml_load(spark, sf_dir):
    """Documents as YAML list files, one file per write task, read back and unfolded."""
    path = fresh_path(spark, "docs-yaml")
    docs = table(spark, sf_dir, "documents")
    item = F.concat(
        F.lit("- id: "), F.col("doc_id"), F.lit("\n  lang: "), F.col("lang"), F.lit("\n  tags: [a, '"), F.col("source"), F.lit("']\n  size: "), F.col("n_chars")
    )
    docs.repartition(8, "doc_id").select(item).write.text(path)
    loaded = files.load_yaml(spark, path)
    items = loaded.select(F.explode(F.variant_get("payload", "$", "array<struct<id:bigint,lang:string,tags:array<string>,size:bigint>>")).alias("d"))
    return items.select("d.id", "d.lang", F.col("d.tags")[1].alias("tag"), "d.size")


def xml_elements(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.col("c_name")
    content = F.when(F.col("c_custkey") % 13 == 0, F.lit("<a><b>open</a>")).otherwise(
        F.concat(F.lit("<c:customer id='1'><c:name>"), name, F.lit(" &amp; Co</c:name>\n  <seg>"), F.col("c_mktsegment"), F.lit("</seg>tail</c:customer>"))
    )
    parsed = files.xml_elements(c.select("c_custkey", content.alias("content")))
    return parsed.select("c_custkey", "position", "element", "content", F.col("error").isNotNull().alias("failed"))


def file_inventory(spark, sf_dir):
    """Documents written by language and source, then listed: files, folders and depth per folder."""
    path = fresh_path(spark, "docs-tree")
    docs = table(spark, sf_dir, "documents")
    docs.select("doc_id", "lang", "source").repartition(4, "lang", "source").write.partitionBy("lang", "source").csv(path)
    listed = files.file_inventory(spark, path)
    # a writer's file names differ from run to run
    plain = lambda c: F.regexp_replace(c, r"part-[0-9a-f-]+.*$", "part").alias(c)
    return listed.select(plain("name"), plain("path"), "depth", "is_dir", "size")


def file_name_search(spark, sf_dir):
    path = fresh_path(spark, "docs-named")
    docs = table(spark, sf_dir, "documents")
    docs.select("doc_id", "lang", "source").repartition(4, "lang", "source").write.partitionBy("lang", "source").csv(path)
    listed = files.file_inventory(spark, path)
    by_folder = listed.withColumn("name", F.regexp_extract("path", r"^lang=(.*)/source=(.*)/", 2))
    return files.find_files(by_folder, "src1").groupBy("name").agg(F.sum("size").alias("bytes"))


def text_search_lines(spark, sf_dir):
    return files.search_lines(table(spark, sf_dir, "documents"), "the")


def document_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(v) for v in ("txt", "json", "YML", "html", "csv", "pdf", "")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return files.document_metadata(docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit("."), ext).alias("path"), "text"))


def audit_jsonl(spark, sf_dir):
    """Two appends and a reload; a day filter prunes the folders."""
    path = fresh_path(spark, "audit-jsonl")
    df = audit_view(spark, sf_dir).drop("props", "user_id")
    files.write_audit(df.filter(F.col("id") % 2 == 0), path)
    files.write_audit(df.filter(F.col("id") % 2 == 1), path)
    back = files.read_audit(spark, path).filter(F.col("day").between("2024-01-05", "2024-01-19"))
    return back.select("id", stamp("timestamp").alias("at"), "actor", "outcome", F.col("details")["k"].alias("k"), F.array_join("tags", ",").alias("tags"))


def audit_export(spark, sf_dir):
    """The filtered log exported as CSV, JSON and XML, each read back."""
    df = audit_op.audit_filter(audit_view(spark, sf_dir), start=START, end=END, outcomes=["Failure"])
    df = df.drop("props", "user_id").withColumn("chain_hash", F.sha2(F.col("actor"), 256))
    out = None
    for fmt in ("csv", "json", "xml"):
        path = fresh_path(spark, f"audit-{fmt}")
        files.export_audit(df, fmt, path)
        schema = "id bigint, actor string, action string, risk_level string, chain_hash string"
        if fmt == "csv":
            back = spark.read.csv(path, header=True).select(F.col("id").cast("bigint").alias("id"), "actor", "action", "risk_level", "chain_hash")
        elif fmt == "json":
            back = spark.read.schema(schema).json(path)
        else:
            back = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
        part = back.withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


# -------------------------------------------------------------------- HTML


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))


def html_text(spark, sf_dir):
    out = html.html_text(_pages(spark, sf_dir))
    return out.select("page_id", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n")).alias("lines"))


def html_structure(spark, sf_dir):
    out = html.html_structure(_pages(spark, sf_dir))
    return out.select("page_id", *html.COUNTED, "title", F.size("headings").alias("headings"))


def html_all(spark, sf_dir):
    """Every value of the one-pass analysis; lists and texts by their hashes."""
    out = html.html_analyze(_pages(spark, sf_dir), "all")
    lines = lambda items, a, b: F.md5(F.array_join(F.transform(items, lambda x: F.concat_ws("|", x[a], x[b])), "\n"))
    return out.select(
        "page_id", "title", "lang", *html.COUNTED, F.md5("text").alias("text_md5"), lines("link_list", "href", "text").alias("links_md5"),
        lines("headings", "level", "text").alias("headings_md5"), lines("metas", "name", "content").alias("metas_md5"))


def html_metadata(spark, sf_dir):
    """Pages with a few meta tags put in from their own fields."""
    p = table(spark, sf_dir, "pages")
    tags = F.concat(
        F.lit("<head><META NAME='description' content=\"page &amp; "), F.col("page_id"),
        F.lit("\"><meta property=og:url content='"), F.col("url"), F.lit("'><meta http-equiv=refresh content=5>"),
    )
    return html.html_metadata(p.select("page_id", F.replace("html", F.lit("<head>"), tags).alias("html")))


# ---------------------------------------------------------- classification


def path_audit(spark, sf_dir):
    n = F.col("page_id")
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    cases = (
        F.when(n % 12 == 0, F.concat(F.lit("/a/../b"), path))
        .when(n % 12 == 1, F.concat(F.lit("/x%2e%2e"), path))
        .when(n % 12 == 2, F.concat(path, F.lit("/con.txt")))
        .when(n % 12 == 3, F.concat(path, F.lit("/.env")))
        .when(n % 12 == 4, F.concat(F.lit("/etc"), path))
        .when(n % 12 == 5, F.concat(path, F.lit("/.gitignore")))
        .when(n % 12 == 6, F.concat(F.lit("/"), F.repeat(F.lit("x"), 4096)))
        .when(n % 12 == 7, F.concat(path, F.lit("/a\u0007b")))
        .when(n % 12 == 8, F.concat(F.lit("//var/./log"), path))
        .otherwise(path)
    )
    return val.classify_paths(table(spark, sf_dir, "pages").select("page_id", cases.alias("path"))).select("page_id", "path_class")


_COMMANDS = ["echo", "/usr/bin/GREP", "curl", "git", "sudo", "python3", "unknown", "wget", "docker", "cargo"]
_FIRST = ["hello", "push", "status", "http://10.0.0.1/x", "https://example.com", "successfully", "su now", "/etc/passwd", "a;b", "~/x", "rm"]


def command_audit(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    df = table(spark, sf_dir, "documents").select(
        "doc_id", pick(_COMMANDS, d).alias("command"),
        F.when(d % 3 == 0, F.concat(F.array(pick(_FIRST, d)), words)).otherwise(F.array(pick(_FIRST, d))).alias("args"),
    )
    return val.classify_commands(df).select("doc_id", "command_class")


def _re2_words(words):
    return "(^|[^\\p{L}\\p{N}])(" + "|".join(words) + ")([^\\p{L}\\p{N}]|$)"


_META_RE = r"[&|;`$><" + '"' + r"''\\\n\r\t]"
_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_COMMAND_SQL = f"""WITH c AS (SELECT doc_id, {_list(_COMMANDS)}[doc_id % {len(_COMMANDS)} + 1] AS command,
        CASE WHEN doc_id % 3 = 0 THEN list_concat([{_list(_FIRST)}[doc_id % {len(_FIRST)} + 1]], list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))
            ELSE [{_list(_FIRST)}[doc_id % {len(_FIRST)} + 1]] END AS args FROM documents),
    k AS (SELECT *, lower(regexp_extract(command, '[^/]*$')) AS base, list_filter(list_transform(args, lambda x:
        CASE WHEN regexp_matches(x, '{_META_RE}') THEN 'metacharacter'
        WHEN regexp_matches(x, '{_re2_words(fv.DENIED_ARGUMENT_WORDS)}') THEN 'denied_word'
        WHEN regexp_matches(x, '/etc/|/proc/|/sys/|/dev/') THEN 'system_path'
        WHEN contains(x, '..') OR contains(x, '~') THEN 'traversal' END), lambda v: v IS NOT NULL)[1] AS found FROM c)
    SELECT doc_id, CASE WHEN list_contains({_list(fv.DENIED_COMMANDS)}, command) THEN 'denied_command' WHEN found IS NOT NULL THEN found
        WHEN NOT list_contains({_list(fv.ALLOWED_COMMANDS)}, base) THEN 'not_allowed'
        WHEN base IN ('curl', 'wget') AND len(list_filter(args, lambda x: regexp_matches(x, '^https?://')
            AND regexp_matches(x, 'localhost|127\\.0\\.0\\.1|192\\.168\\.|10\\.|172\\.'))) > 0 THEN 'private_host'
        WHEN base = 'git' AND lower(args[1]) IN ('push', 'pull', 'fetch', 'clone', 'remote', 'config') THEN 'remote_git'
        ELSE 'ok' END AS command_class FROM k"""


_HOSTS = ["ftp://a/b", "http://localhost:80/", "http://127.0.0.9/", "https://10.1.2.3/x", "http://172.20.0.1", "http://172.40.0.1",
          "http://[fd00::1]/", "http://[::1]/", "http://db.internal/x", "http://u@printer.local", "http://", "https://169.254.1.1/"]


def _urls(spark, sf_dir):
    n = F.col("page_id")
    special = F.element_at(F.array(*[F.lit(h) for h in _HOSTS]), (n % len(_HOSTS) + 1).cast("int"))
    url = F.when(n % 2 == 0, F.col("url")).when(n % 26 == 1, F.concat("url", F.repeat(F.lit("y"), 2048))).otherwise(special)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


_URLS_SQL = f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 26 = 1 THEN url || repeat('y', 2048)
    ELSE {_list(_HOSTS)}[page_id % {len(_HOSTS)} + 1] END AS url FROM pages) """


def ssrf_class(spark, sf_dir):
    return val.classify_urls(_urls(spark, sf_dir)).select("page_id", "url_class")


def url_safety(spark, sf_dir):
    from tidemark.operators.workflow import url_is_safe

    return _urls(spark, sf_dir).select("page_id", url_is_safe(F.col("url")).alias("is_safe"))


def unsafe_value(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("v"))
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat("c_name", F.when(F.col("c_custkey") % 4 == 0, "--").otherwise("-")).alias("v"))
    return docs.unionByName(names).select("id", val.has_unsafe_pattern(F.col("v")).alias("unsafe"))


RULES = {
    "c_name": val.Rule(required=True, min_length=5, max_length=18, pattern=r"^[A-Za-z#0-9]+$"),
    "c_mktsegment": val.Rule(allowed=["BUILDING", "MACHINERY", "HOUSEHOLD"]),
    "note": val.Rule(required=True, max_length=12),
}


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 10 != 0, F.when(k % 10 == 1, F.concat("c_name", F.lit("x"))).when(k % 10 == 2, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.col("c_name"))).alias("c_name"),
        "c_mktsegment", F.when(k % 4 != 0, F.when(k % 7 == 0, "a<b").otherwise(F.repeat(F.lit("n"), (k % 15).cast("int")))).alias("note"),
    )


_CUSTOMERS_SQL = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN c_name || 'x'
        WHEN c_custkey % 10 = 2 THEN replace(c_name, '#', '_') ELSE c_name END AS c_name, c_mktsegment,
        CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'a<b' ELSE repeat('n', c_custkey % 15) END AS note FROM customer),
    e AS (SELECT c_custkey, CASE WHEN c_name IS NULL THEN 'required' WHEN strlen(c_name) < 5 THEN 'too_short' WHEN strlen(c_name) > 18 THEN 'too_long'
            WHEN regexp_matches(c_name, '[<>&"'']') THEN 'prohibited' WHEN NOT regexp_matches(c_name, '^[A-Za-z#0-9]+$') THEN 'format' END AS c_name_error,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'not_allowed' END AS c_mktsegment_error,
        CASE WHEN note IS NULL THEN 'required' WHEN strlen(note) > 12 THEN 'too_long' WHEN contains(note, '<') THEN 'prohibited' END AS note_error FROM c) """


def column_rules(spark, sf_dir):
    out = val.validate(_customers(spark, sf_dir), RULES)
    return out.select("c_custkey", "c_name_error", "c_mktsegment_error", "note_error")


def document_rules(spark, sf_dir):
    out = val.validate(table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": val.Rule(required=True, min_length=20, max_length=50_000)})
    return out.select("doc_id", "text_error")


def row_errors(spark, sf_dir):
    out = val.validate_rows(_customers(spark, sf_dir), RULES)
    return out.select("c_custkey", "state", F.array_join("errors", "; ").alias("errors"))


def rule_presets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    text = F.col("text")
    rows = d.select(
        "doc_id", F.concat(F.col("source"), F.when(n % 5 == 0, "!").otherwise("")).alias("name"),
        F.concat(n % 9, F.lit("."), n % 4, F.when(n % 3 == 0, ".x").otherwise("")).alias("version"), text.alias("description"),
        F.col("source").alias("tool_name"), text.alias("command"), F.concat(F.col("lang"), F.when(n % 2 == 0, "/").otherwise(":"), n).alias("file_path"),
        F.md5(n.cast("string")).alias("api_key"), F.concat(F.when(n % 4 == 0, "").otherwise("/"), F.col("source")).alias("endpoint"), text.alias("user_input"),
    )
    out = None
    for preset, rules in val.PRESETS.items():
        part = val.validate_rows(rows, rules).select("doc_id", F.lit(preset).alias("preset"), "state", F.array_join("errors", "; ").alias("errors"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "csv_load": csv_load,
    "csv_load_header": csv_header,
    "csv_rows_text": csv_rows_text,
    "csv_profile": csv_profile,
    "json_load": json_load,
    "json_load_typed": json_load_typed,
    "structured_profile": structured_profile,
    "yaml_load": yaml_load,
    "xml_elements": xml_elements,
    "file_inventory": file_inventory,
    "file_name_search": file_name_search,
    "text_search_lines": text_search_lines,
    "document_metadata": document_metadata,
    "audit_jsonl": audit_jsonl,
    "audit_export": audit_export,
    "html_text": html_text,
    "html_structure": html_structure,
    "html_headings": lambda s, d: html.html_headings(_pages(s, d)),
    "html_links": lambda s, d: html.html_links(_pages(s, d)),
    "html_metadata": html_metadata,
    "html_all": html_all,
    "path_audit": path_audit,
    "command_audit": command_audit,
    "ssrf_class": ssrf_class,
    "url_safety": url_safety,
    "unsafe_value": unsafe_value,
    "column_rules": column_rules,
    "document_rules": document_rules,
    "row_errors": row_errors,
    "rule_presets": rule_presets,
}

_CLEAN_SQL = """p AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS h FROM pages)"""
_ENTITIES = [("&quot;", '"'), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def _decode(expr):
    for name, char in _ENTITIES:
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


def _plain_sql(expr):
    return f"regexp_replace({expr}, '<[^>]*>', '', 'g')"


_trim = lambda e: f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
_COUNT_SQL = ", ".join(f"CAST(len(regexp_extract_all(h, '(?i)<{tag}[\\s/>]')) AS INTEGER) AS {name}" for name, tag in html.COUNTED.items())
_TITLE = f"nullif({_trim(_decode('regexp_extract(h, $$(?is)<title>(.*?)</title>$$, 1)'))}, '')"
_BODY_TEXT = f"""array_to_string(list_filter(list_transform(string_split({_decode("regexp_replace(regexp_extract(h, $$(?is)<body>(.*?)(?:</body>|\\z)$$, 1), '(<[^>]*>)+', ' ', 'g')")}, chr(10)),
    lambda v: {_trim('v')}), lambda v: v <> ''), chr(10))"""

ORACLE = {
    "csv_load": """SELECT CAST(o_orderkey AS VARCHAR) AS "Column_1", replace(o_orderpriority, '-', ';') AS "Column_2", o_orderstatus AS "Column_3",
        CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS "Column_4",
        CASE WHEN o_orderkey % 35 = 1 THEN 'extra' END AS "Column_5" FROM orders""",
    "csv_load_header": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer",
    "csv_rows_text": """SELECT n_nationkey + 1 AS row, CASE WHEN n_nationkey % 6 = 0 THEN 'Row ' || (n_nationkey + 1) || ': ' || n_name
            ELSE 'Row ' || (n_nationkey + 1) || ':' || chr(10) || '  name: ' || n_name || chr(10) || '  region: ' || n_regionkey END AS text FROM nation
        UNION ALL SELECT r_regionkey + 101, 'Row ' || (r_regionkey + 101) || ':' || chr(10) || '  name: ' || r_name || chr(10) || '  region: ' || r_regionkey FROM region
        UNION ALL SELECT 0, '2 / ' || ((SELECT count(*) FROM nation) + (SELECT count(*) FROM region)) || ' / name, region'""",
    "csv_profile": """SELECT o_custkey AS id, 'key|status' AS headers, string_agg(o_orderkey || '|' || o_orderstatus || ', "x"', '|' ORDER BY CAST(o_orderkey AS VARCHAR) || ',')
            || CASE WHEN o_custkey % 9 = 0 THEN '|only_one' ELSE '' END AS cells,
        CAST(count(*) + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) AS row_count, o_custkey % 9 <> 0 AS valid FROM orders GROUP BY o_custkey""",
    "json_load": f"""WITH {_PROPS_SQL} SELECT event_id, event_id % 10 <> 0 AS valid,
        CASE WHEN event_id % 10 > 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CAST(CASE WHEN event_id % 10 = 2 THEN 2 END AS INTEGER) AS y FROM events""",
    "json_load_typed": """SELECT event_id, event_id % 10 IN (2, 6, 7, 8, 9) AS valid,
        CASE WHEN event_id % 10 > 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
    "structured_profile": """SELECT event_id, 'JSON' AS format, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 IN (1, 3, 5) THEN 'Array' WHEN event_id % 10 = 4 THEN 'String' ELSE 'Object' END AS root_type,
        CAST(CASE WHEN event_id % 10 = 2 THEN 3 WHEN event_id % 10 > 5 THEN 1 END AS INTEGER) AS key_count,
        CASE WHEN event_id % 10 = 2 THEN 'b,event,z' WHEN event_id % 10 > 5 THEN 'k' END AS top_keys,
        CAST(CASE event_id % 10 WHEN 1 THEN 2 WHEN 3 THEN 0 WHEN 5 THEN 2 END AS INTEGER) AS array_length,
        CASE event_id % 10 WHEN 1 THEN 'Number' WHEN 5 THEN 'Array' END AS first_element_type FROM events""",
    "yaml_load": "SELECT doc_id AS id, lang, source AS tag, n_chars AS size FROM documents",
    "xml_elements": """SELECT c_custkey, 0 AS position, 'name' AS element, c_name || ' & Co' AS content, false AS failed FROM customer WHERE c_custkey % 13 <> 0
        UNION ALL SELECT c_custkey, 1, 'seg', c_mktsegment, false FROM customer WHERE c_custkey % 13 <> 0
        UNION ALL SELECT c_custkey, 2, 'seg', 'tail', false FROM customer WHERE c_custkey % 13 <> 0
        UNION ALL SELECT c_custkey, NULL, NULL, NULL, true FROM customer WHERE c_custkey % 13 = 0""",
    "file_inventory": """WITH f AS (SELECT 'lang=' || lang AS l, 'source=' || source AS s, CAST(sum(strlen(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS size
            FROM documents GROUP BY 1, 2)
        SELECT DISTINCT l AS name, l AS path, 0 AS depth, true AS is_dir, CAST(NULL AS BIGINT) AS size FROM f
        UNION ALL SELECT s, l || '/' || s, 1, true, NULL FROM f UNION ALL SELECT 'part', l || '/' || s || '/part', 2, false, size FROM f
        UNION ALL SELECT '_SUCCESS', '_SUCCESS', 0, false, 0""",
    "file_name_search": """SELECT source AS name, CAST(sum(strlen(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM documents
        WHERE contains(source, 'src1') GROUP BY 1""",
    "text_search_lines": f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS v FROM documents)
        SELECT doc_id, CAST(line AS INTEGER) AS line, {_trim('v')} AS content FROM l WHERE contains(v, 'the')""",
    "document_metadata": """WITH d AS (SELECT ['txt', 'json', 'YML', 'html', 'csv', 'pdf', ''][doc_id % 7 + 1] AS ext, * FROM documents)
        SELECT source || '/' || doc_id || '.' || ext AS path, CAST(strlen(text) AS INTEGER) AS file_size,
        CASE ext WHEN 'json' THEN 'application/json' WHEN 'YML' THEN 'application/yaml' WHEN 'html' THEN 'text/html' WHEN 'csv' THEN 'text/csv'
            WHEN 'pdf' THEN 'application/pdf' ELSE 'text/plain' END AS content_type, 1 AS pages FROM d""",
    "audit_jsonl": AUDIT
    + f"""SELECT id, strftime(timestamp, '{SQL_STAMP}') AS at, actor, outcome, json_extract_string(props, '$.k') AS k,
        't' || (id % 3) || ',' || action AS tags FROM audit WHERE {PERIOD}""",
    "audit_export": AUDIT
    + f"""SELECT id, actor, action, risk_level, sha256(actor) AS chain_hash, format FROM audit, (VALUES ('csv'), ('json'), ('xml')) t(format)
        WHERE {PERIOD} AND outcome = 'Failure'""",
    "html_text": f"""WITH {_CLEAN_SQL}, t AS (SELECT page_id, {_BODY_TEXT} AS text FROM p)
        SELECT page_id, md5(text) AS text_md5, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM t""",
    "html_structure": f"""WITH {_CLEAN_SQL} SELECT page_id, {_COUNT_SQL}, {_TITLE} AS title,
        CAST(len(regexp_extract_all(h, '(?is)<h[1-6]>.*?</h[1-6]>')) AS INTEGER) AS headings FROM p""",
    "html_headings": f"""WITH {_CLEAN_SQL}, x AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<h[1-6]>.*?</h[1-6]>')) AS t,
            generate_subscripts(regexp_extract_all(h, '(?is)<h[1-6]>.*?</h[1-6]>'), 1) - 1 AS position FROM p)
        SELECT page_id, CAST(position AS INTEGER) AS position, CAST(substr(t, 3, 1) AS INTEGER) AS level, {_decode(_trim(_plain_sql('t')))} AS text FROM x""",
    "html_links": f"""WITH {_CLEAN_SQL}, x AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<a\\s[^>]*>.*?</a>')) AS t,
            generate_subscripts(regexp_extract_all(h, '(?is)<a\\s[^>]*>.*?</a>'), 1) - 1 AS position FROM p)
        SELECT page_id, CAST(position AS INTEGER) AS position, {_decode("regexp_extract(t, 'href=$$([^$$]*)$$'.replace('$$', chr(34)), 1)")} AS href,
        coalesce(nullif({_trim(_decode(_plain_sql('t')))}, ''), '(no text)') AS text FROM x""",
    "html_metadata": f"""WITH {_CLEAN_SQL}, m AS (
        SELECT page_id, 0 AS position, 'description' AS name, 'page & ' || page_id AS content FROM p
        UNION ALL SELECT page_id, 1, 'og:url', url FROM p UNION ALL SELECT page_id, 2, 'refresh', '5' FROM p
        UNION ALL SELECT page_id, 3, 'title', {_TITLE} FROM p WHERE {_TITLE} IS NOT NULL
        UNION ALL SELECT page_id, CASE WHEN {_TITLE} IS NULL THEN 3 ELSE 4 END, 'lang', regexp_extract(h, '<html lang="([a-z]+)"', 1) FROM p)
        SELECT page_id, CAST(position AS INTEGER) AS position, name, content FROM m""",
    "path_audit": """SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'traversal' WHEN 1 THEN 'encoded_traversal' WHEN 2 THEN 'reserved_name'
        WHEN 3 THEN 'hidden' WHEN 4 THEN 'system_directory' WHEN 6 THEN 'too_long' WHEN 7 THEN 'control_character' WHEN 8 THEN 'system_directory' ELSE 'ok' END AS path_class FROM pages""",
    "command_audit": _COMMAND_SQL,
    "ssrf_class": _URLS_SQL
    + """SELECT page_id, CASE WHEN url LIKE 'ftp%' THEN 'bad_scheme' WHEN url = 'http://' THEN 'invalid'
        WHEN url LIKE 'http://localhost%' OR url LIKE 'http://127%' OR url LIKE 'http://[::1%' THEN 'localhost'
        WHEN url LIKE 'https://10.%' OR url LIKE 'http://172.20%' OR url LIKE 'http://[fd%' OR url LIKE 'https://169.254%' THEN 'private_ip'
        WHEN url LIKE '%.internal/x' OR url LIKE '%printer.local' THEN 'private_host' WHEN strlen(url) > 2048 THEN 'too_long' ELSE 'ok' END AS url_class FROM u""",
    "url_safety": _URLS_SQL
    + """SELECT page_id, regexp_matches(url, 'localhost|127\\.0\\.0\\.1|192\\.168\\.|10\\.|172\\.16\\.') OR starts_with(url, 'https://') AS is_safe FROM u""",
    "unsafe_value": """WITH v AS (SELECT 'd' || doc_id AS id, text AS v FROM documents
        UNION ALL SELECT 'c' || c_custkey, c_name || CASE WHEN c_custkey % 4 = 0 THEN '--' ELSE '-' END FROM customer)
        SELECT id, """
    + " OR ".join(
        "contains(v, " + {"\n": "chr(10)", "\r": "chr(13)", "\t": "chr(9)", "\0": "chr(0)"}.get(w, "'" + w.replace("'", "''") + "'") + ")"
        for w in fv.UNSAFE_VALUE_TEXT
        if w != "\0"
    )
    + " AS unsafe FROM v",
    "column_rules": _CUSTOMERS_SQL + "SELECT * FROM e",
    "document_rules": """SELECT doc_id, CASE WHEN strlen(text) < 20 THEN 'too_short' WHEN strlen(text) > 50000 THEN 'too_long'
        WHEN regexp_matches(text, '[<>&"'']') THEN 'prohibited' END AS text_error FROM documents""",
    "row_errors": _CUSTOMERS_SQL
    + """SELECT c_custkey, CASE len(errs) WHEN 0 THEN 'valid' WHEN 1 THEN 'one' ELSE 'multiple' END AS state, array_to_string(errs, '; ') AS errors
        FROM (SELECT c_custkey, list_filter(['c_name: ' || c_name_error, 'c_mktsegment: ' || c_mktsegment_error, 'note: ' || note_error], lambda x: x IS NOT NULL) AS errs FROM e)""",
    "rule_presets": """WITH r AS (SELECT doc_id, text, source, 'd' AS one,
            CASE WHEN doc_id % 5 = 0 THEN 'name: format' END AS e_name, CASE WHEN doc_id % 3 = 0 THEN 'version: format' END AS e_version,
            CASE WHEN strlen(text) > 1000 THEN 'description: too_long' WHEN regexp_matches(text, '[<>&"'']') THEN 'description: prohibited' END AS e_desc,
            CASE WHEN strlen(text) > 500 THEN 'command: too_long' WHEN regexp_matches(text, '[&|;`$]') THEN 'command: prohibited' END AS e_cmd,
            CASE WHEN doc_id % 2 = 1 THEN 'file_path: prohibited' END AS e_path,
            CASE WHEN doc_id % 4 = 0 THEN 'endpoint: format' END AS e_end,
            CASE WHEN strlen(text) > 10000 THEN 'user_input: too_long' WHEN regexp_matches(text, '[<>&"'']') THEN 'user_input: prohibited' END AS e_in FROM documents),
        s AS (SELECT doc_id, 'workflow' AS preset, list_filter([e_name, e_version, e_desc], lambda x: x IS NOT NULL) AS errs FROM r
            UNION ALL SELECT doc_id, 'tool_input', list_filter([e_cmd, e_path], lambda x: x IS NOT NULL) FROM r
            UNION ALL SELECT doc_id, 'api_input', list_filter([e_end, e_in], lambda x: x IS NOT NULL) FROM r)
        SELECT doc_id, preset, CASE len(errs) WHEN 0 THEN 'valid' WHEN 1 THEN 'one' ELSE 'multiple' END AS state, array_to_string(errs, '; ') AS errors FROM s""",
}
# a quoted attribute pattern reads better without escapes inside the f-string above
ORACLE["html_links"] = ORACLE["html_links"].replace("'href=$$([^$$]*)$$'.replace('$$', chr(34))", "'href=\"([^\"]*)\"'")
_LINES = "SELECT page_id, md5(string_agg({a} || '|' || {b}, chr(10) ORDER BY position)) AS m FROM ({rows}) GROUP BY 1"
ORACLE["html_all"] = f"""WITH {_CLEAN_SQL}, t AS (SELECT *, {_TITLE} AS title, regexp_extract(h, '<html lang="([a-z]+)"', 1) AS lang FROM p),
    l AS ({_LINES.format(a="href", b="text", rows=ORACLE["html_links"])}), g AS ({_LINES.format(a="level", b="text", rows=ORACLE["html_headings"])})
    SELECT t.page_id, title, lang, {_COUNT_SQL}, md5({_BODY_TEXT}) AS text_md5, coalesce(l.m, md5('')) AS links_md5, coalesce(g.m, md5('')) AS headings_md5,
    md5(concat_ws(chr(10), 'title|' || title, 'lang|' || lang)) AS metas_md5 FROM t LEFT JOIN l USING (page_id) LEFT JOIN g USING (page_id)"""
