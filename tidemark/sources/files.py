"""Readers and writers: CSV, JSON, YAML, XML, file listings, audit logs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import EXPORT_COLUMNS
from tidemark.sources.listing import FolderSource

# --------------------------------------------------------------------- CSV


_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_BROKEN = "_broken_record"


def _width(spark: SparkSession, path: str, delimiter: str, multi_line: bool) -> int:
    """Fields in the widest record; delimiters and line ends inside quotes do not count."""
    # with a schema of one column the reader hands over every wider record as it stands in the file
    probe = spark.read.csv(path, schema=f"one string, {_BROKEN} string", sep=delimiter, escape='"', multiLine=multi_line,
                           mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN, enforceSchema=True)
    bare = F.regexp_replace(_BROKEN, _QUOTED, "")
    fields = F.size(F.split(bare, "\\Q" + delimiter + "\\E", -1))
    # the reader refuses a query of the broken records alone, so the other column takes part
    width = F.when(F.col(_BROKEN).isNotNull(), fields).otherwise(F.least(F.length("one"), F.lit(1)))
    return probe.agg(F.max(width)).first()[0] or 1


def load_csv(
    spark: SparkSession, path: str, delimiter: str = ",", has_headers: bool = True, multi_line: bool = True
) -> DataFrame:
    """All-string columns; without headers ``Column_1..n``; ragged rows are kept.

    Short rows are padded with nulls. Rows wider than the header go on in ``Column_<n>``, up to the widest
    record. A quoted field may hold line ends, so a file is one task; say ``multi_line=False`` for files
    without such fields, and they are split.
    """
    names: list[str] = []
    if has_headers:
        names = spark.read.csv(path, sep=delimiter, header=True, escape='"', multiLine=multi_line).columns
    width = max(_width(spark, path, delimiter, multi_line), len(names))
    names += [f"Column_{i}" for i in range(len(names) + 1, width + 1)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, sep=delimiter, header=has_headers, escape='"', multiLine=multi_line, mode="PERMISSIVE")


def csv_as_text(df: DataFrame, index: str | None = None) -> DataFrame:
    """One ``text`` per row: ``header: value`` lines, or the values joined by `` | `` when ragged."""
    names = [c for c in df.columns if c != index]
    # a null cell stands for a missing field
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col(name).isNotNull()
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"  {n}: "), F.col(n).cast("string")) for n in names])
    bar = F.concat_ws(" | ", *[F.col(n).cast("string") for n in names])
    title = F.concat(F.lit("Row "), F.col(index).cast("string"), F.lit(":")) if index else F.lit("Row:")
    text = F.when(whole, F.concat(title, F.lit("\n"), lines)).otherwise(F.concat(title, F.lit(" "), bar))
    return df.select(*([index] if index else []), text.alias("text"))


def csv_summary(df: DataFrame) -> DataFrame:
    names = df.columns
    return df.agg(
        F.lit(len(names)).alias("columns"), F.count("*").alias("rows"), F.lit(", ".join(names)).alias("column_names")
    )


def _fields(line: Column, delimiter: str) -> Column:
    d = "\\" + delimiter
    found = F.regexp_extract_all(
        F.concat(F.lit(delimiter), line), F.lit(rf'{d}({_QUOTED}|[^{d}]*+)'), F.lit(1)
    )
    return F.transform(
        found,
        lambda v: F.when(
            v.startswith('"') & v.endswith('"') & (F.char_length(v) > 1),
            F.replace(F.substring(v, F.lit(2), F.char_length(v) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(v),
    )


def csv_profile(df: DataFrame, content: str = "content", delimiter: str = ",") -> DataFrame:
    """A column of CSV text to headers, records, row_count; ``valid`` when all rows fit the header.

    Line ends inside quotes belong to their field; a quote that never closes ends with its line.
    """
    record = r'(?:[^"\r\n]++|"[^"]*+"|"[^\r\n]*+)++'
    lines = F.regexp_extract_all(F.col(content), F.lit(record), F.lit(0))
    parsed = df.withColumn("_lines", lines)
    records = F.transform(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))), lambda v: _fields(v, delimiter))
    return (
        parsed.withColumn("headers", F.when(F.size("_lines") > 0, _fields(F.element_at("_lines", 1), delimiter)).otherwise(F.array()))
        .withColumn("records", records)
        .withColumn("row_count", F.size("records"))
        .withColumn("valid", F.forall("records", lambda r: F.size(r) == F.size("headers")))
        .drop("_lines", content)
    )


# ------------------------------------------------------------ JSON and YAML


def load_json(source: DataFrame | str, content: str = "content", spark: SparkSession | None = None, schema: str | None = None) -> DataFrame:
    """Typed payload from a JSON column or from files (one document per file).

    ``payload`` is a VARIANT, or a struct when a schema is given; ``valid``
    says whether the text is JSON (and, with a schema, fits it).
    """
    if isinstance(source, str):
        files = (spark or SparkSession.active()).read.text(source, wholetext=True)
        source = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(content))
    text = F.col(content)
    if schema is None:
        payload = F.try_parse_json(text)
        return source.withColumn("payload", payload).withColumn("valid", F.col("payload").isNotNull())
    checked = F.from_json(text, schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    parsed = source.withColumn("_p", checked)
    return (
        parsed.withColumn("valid", F.col("_p").isNotNull() & F.col("_p._corrupt").isNull() & text.isNotNull())
        .withColumn("payload", F.col("_p").dropFields("_corrupt"))
        .drop("_p")
    )


def profile_json(df: DataFrame, content: str = "content", fmt: str = "json") -> DataFrame:
    """Root type, key count, first ten keys, array length, first element type, pretty text."""
    text = F.col(content)
    parsed = df.withColumn("_v", F.try_parse_json(text))
    # the outermost kind shows in the first character; JSON null is a VARIANT null
    lead = F.substring(F.ltrim(F.regexp_replace(text, r"^\s+", "")), 1, 1)
    kind = lambda c: (
        F.when(c == "{", "Object").when(c == "[", "Array").when(c == '"', "String")
        .when(c.isin("t", "f"), "Boolean").when(c == "n", "Null").otherwise("Number")
    )
    root = F.when(F.col("_v").isNotNull(), kind(lead))
    keys = F.array_sort(F.array_distinct(F.json_object_keys(text)))
    first = F.substring(F.ltrim(F.to_json(F.try_variant_get("_v", "$[0]", "variant"))), 1, 1)
    length = F.when(root == "Array", F.json_array_length(text))
    return parsed.select(
        *[c for c in df.columns if c != content],
        F.lit(fmt.upper()).alias("format"),
        root.alias("root_type"),
        F.when(root == "Object", F.size(keys)).alias("key_count"),
        F.when(root == "Object", F.slice(keys, 1, 10)).alias("top_keys"),
        length.alias("array_length"),
        F.when(length > 0, kind(first)).alias("first_element_type"),
        F.to_json("_v", {"pretty": "true"}).alias("pretty"),
    )


def load_yaml(spark: SparkSession, path: str, force: str | None = None) -> DataFrame:
    """One row per file: path, format (by extension unless forced), payload VARIANT, error.

    Files are parsed where they lie, a file per Python call; only the parse is
    Python, the payload is a VARIANT from then on.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"]):
                fmt = force or ("json" if name.lower().endswith(".json") else "yaml")
                try:
                    data = json.loads(raw) if fmt == "json" else yaml.load(raw, Loader=loader)
                    rows.append((name, fmt, json.dumps(data, default=str, ensure_ascii=False), None))
                except (ValueError, yaml.YAMLError) as e:
                    rows.append((name, fmt, None, f"{fmt} parsing error: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "json", "error"])

    parsed = files.mapInPandas(parse, "path string, format string, json string, error string")
    return parsed.withColumn("payload", F.try_parse_json("json")).drop("json")


# --------------------------------------------------------------------- XML


def _xml_pairs(text: str) -> list[dict]:
    """(element, content) in document order; text belongs to the last opened element."""
    out, state = [], {"name": ""}
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.buffer_size = max(len(text) * 4, 1024)

    def opened(name, _attrs):
        state["name"] = name.split(":")[-1]

    def chars(data):
        if state["name"] and data.strip():
            out.append({"element": state["name"], "content": data})

    parser.StartElementHandler, parser.CharacterDataHandler = opened, chars
    parser.EndElementHandler = lambda _name: None  # closes the running text, too
    parser.Parse(text, True)
    return out


def xml_elements(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per text of an element; a malformed document gives one row with ``error``."""

    @F.pandas_udf("struct<pairs:array<struct<element:string,content:string>>,error:string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        pairs, errors = [], []
        for text in texts:
            try:
                pairs.append(_xml_pairs(text) if text is not None else [])
                errors.append(None)
            except expat.ExpatError as e:
                pairs.append([])
                errors.append(str(e))
        return pd.DataFrame({"pairs": pairs, "error": errors})

    rest = [c for c in df.columns if c != content]
    parsed = df.select(*rest, parse(F.col(content)).alias("_x"))
    return parsed.select(*rest, F.col("_x.error").alias("error"), F.posexplode_outer("_x.pairs").alias("position", "_p")).filter(
        F.col("error").isNotNull() | F.col("_p").isNotNull()
    ).select(*rest, "position", F.col("_p.element").alias("element"), F.col("_p.content").alias("content"), "error")


# ---------------------------------------------------------------- listings


def file_inventory(
    spark: SparkSession, path: str, recursive: bool = True, max_depth: int | None = None, include_hidden: bool = False
) -> DataFrame:
    """(name, path, depth, is_dir, size, modified) of the files and folders below ``path``, by name.

    ``path`` is relative, ``depth`` counts the folders on the way and folders have no size. What is hidden, or lies
    in a hidden folder, has a name that begins with a dot. Folders are listed by tasks, see ``listing``; only
    metadata is read, never the contents.
    """
    spark.dataSource.register(FolderSource)
    reader = spark.read.format(FolderSource.name()).option("recursive", str(recursive).lower()).option("includeHidden", str(include_hidden).lower())
    if max_depth is not None:
        reader = reader.option("maxDepth", str(max_depth))
    listed = reader.load(path)
    if max_depth is not None:
        listed = listed.filter(F.col("depth") <= max_depth)
    return listed.orderBy("name", "path")


def find_files(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(F.col("name").contains(pattern))


def search_lines(df: DataFrame, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, content) of every line holding the literal; documents without it are not split."""
    hits = df.filter(F.col(text).contains(pattern))
    lines = hits.select(doc, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("_n", "_line"))
    return lines.filter(F.col("_line").contains(pattern)).select(
        doc, (F.col("_n") + 1).alias("line"), F.regexp_replace("_line", r"(?U)^\s+|\s+$", "").alias("content")
    )


# Content type by file extension.
CONTENT_TYPES = {
    "pdf": "application/pdf", "csv": "text/csv", "json": "application/json", "yaml": "application/yaml",
    "yml": "application/yaml", "html": "text/html", "htm": "text/html",
}


def document_metadata(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, file_size in bytes, content_type, pages) per loaded document."""
    extension = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    kind = F.lit("text/plain")
    for ext, name in CONTENT_TYPES.items():
        kind = F.when(extension == ext, name).otherwise(kind)
    return df.select(path, F.octet_length(text).alias("file_size"), kind.alias("content_type"), F.lit(1).alias("pages"))


# --------------------------------------------------------------- audit logs

AUDIT_SCHEMA = (
    "id bigint, timestamp timestamp_ntz, event_type string, actor string, resource string, action string, "
    "outcome string, risk_level string, details map<string,string>, session_id string, tool_name string, "
    "mission_id string, correlation_id string, execution_time_ms double, memory_usage_mb bigint, "
    "tags array<string>, previous_hash string, chain_hash string"
)


_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CHAINED_SCHEMA = AUDIT_SCHEMA + ", log_id string, seq bigint"
JSON_TIMES = {"timestampNTZFormat": _STAMP, "timestampFormat": _STAMP + "XXX"}


def write_audit(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the newline-JSON log, one folder per day so that time filters prune."""
    day = df.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    day.write.mode(mode).partitionBy("day").options(**JSON_TIMES).json(path)


def read_audit(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema + ", day string").options(**JSON_TIMES).json(path)


def export_audit(df: DataFrame, fmt: str, path: str) -> None:
    """Write the (already filtered) log as json, csv, xml or yaml."""
    kind = fmt.lower()
    if kind == "json":
        df.write.mode("errorifexists").options(**JSON_TIMES).json(path)
    elif kind == "csv":
        stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
        df.withColumn("timestamp", stamp).select(*EXPORT_COLUMNS).write.csv(path, header=True)
    elif kind == "xml":
        plain = [F.to_json(n).alias(n) if "map<" in k or "array<" in k else F.col(n) for n, k in df.dtypes]
        df.select(*plain).write.format("xml").option("rootTag", "audit_log").option("rowTag", "entry").save(path)
    elif kind == "yaml":
        # a JSON object is a YAML flow mapping, so every line is one list item
        df.select(F.concat(F.lit("- "), F.to_json(F.struct(*df.columns)))).write.text(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
