"""Column rules, and classification of paths, commands and URLs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv

# ------------------------------------------------------------- column rules


@dataclass(frozen=True)
class Rule:
    """Checks of one column; lengths are bytes. The default bans ``< > & " '``."""

    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    allowed: Sequence[str] | None = None
    prohibited: str | None = "<>&\"'"
    pattern: str | None = None


# The three ready rule sets.
PRESETS: dict[str, dict[str, Rule]] = {
    "workflow": {
        "name": Rule(required=True, min_length=1, max_length=100, pattern=r"^[a-zA-Z0-9\s\-_]+$"),
        "version": Rule(required=True, pattern=r"^\d+\.\d+(\.\d+)?$"),
        "description": Rule(max_length=1000),
    },
    "tool_input": {
        "tool_name": Rule(required=True, min_length=1, max_length=50, pattern=r"^[a-zA-Z0-9_]+$"),
        "command": Rule(max_length=500, prohibited="&|;`$"),
        "file_path": Rule(max_length=255, prohibited='<>:"|?*'),
    },
    "api_input": {
        "api_key": Rule(required=True, min_length=16, max_length=128, pattern=r"^[a-zA-Z0-9\-_]+$"),
        "endpoint": Rule(required=True, max_length=200, pattern=r"^/[a-zA-Z0-9\-_/]*$"),
        "user_input": Rule(max_length=10000, prohibited="<>&\"'"),
    },
}


def rule_error(value: Column, rule: Rule) -> Column:
    """First failing check: required, too_short, too_long, not_allowed, prohibited, format; else null."""
    size = F.octet_length(value)
    checks: list[tuple[Column, str]] = []
    if rule.required:
        checks.append((value.isNull(), "required"))
    if rule.min_length is not None:
        checks.append((size < rule.min_length, "too_short"))
    if rule.max_length is not None:
        checks.append((size > rule.max_length, "too_long"))
    if rule.allowed is not None:
        checks.append((~value.isin(list(rule.allowed)), "not_allowed"))
    if rule.prohibited:
        checks.append((value.rlike("[" + "".join(re.escape(c) for c in rule.prohibited) + "]"), "prohibited"))
    if rule.pattern is not None:
        # `$` must be the very end, and classes know all of Unicode
        exact = re.sub(r"\$$", r"\\z", rule.pattern)
        checks.append((~value.rlike("(?U)" + exact), "format"))
    out = F.lit(None).cast("string")
    for failed, code in reversed(checks):
        out = F.when(failed, code).otherwise(out)
    return out


def validate(df: DataFrame, rules: Mapping[str, Rule], default: Rule = Rule()) -> DataFrame:
    """Add ``<column>_error`` for every string column; columns without a rule get the default."""
    names = [n for n, kind in df.dtypes if kind == "string" or n in rules]
    return df.select("*", *[rule_error(F.col(n), rules.get(n, default)).alias(f"{n}_error") for n in names])


def validate_rows(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Add ``errors`` (column: code) and ``state``: valid, one or multiple."""
    found = [F.concat(F.lit(n + ": "), rule_error(F.col(n), r)) for n, r in rules.items()]
    errors = F.filter(F.array(*found), lambda e: e.isNotNull())
    count = F.size("errors")
    state = F.when(count == 0, "valid").when(count == 1, "one").otherwise("multiple")
    return df.withColumn("errors", errors).withColumn("state", state)


# ------------------------------------------------------------------- values


def _any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(_quote(w) for w in words) + ")"


def _quote(word: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-&/" else {"\0": r"\x00", "\n": r"\n", "\r": r"\r", "\t": r"\t"}.get(c, c) for c in word)


def has_unsafe_pattern(value: Column) -> Column:
    singles = [w for w in fv.UNSAFE_VALUE_TEXT if len(w) == 1]
    longer = [w for w in fv.UNSAFE_VALUE_TEXT if len(w) > 1]
    return value.rlike("[" + "".join(_quote(w) for w in singles) + "]|" + _any_of(longer))


def file_name(path: Column) -> Column:
    """Last component, ignoring closing slashes and ``/.``."""
    return F.regexp_extract(F.regexp_replace(path, r"(?:/\.?)+$", ""), r"([^/]*)$", 1)


def classify_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``path_class``: the first matching risk, or ``ok``; no file is touched."""
    p = F.col(path)
    name = file_name(p)
    tidy = F.regexp_replace(F.regexp_replace(p, r"/(?:\./)+", "/"), "/+", "/")
    reserved = rf"(?is)^(?:{'|'.join(fv.RESERVED_NAMES)})(?:\..*)?$"
    encoded = F.lit(False)
    for text in fv.ENCODED_TRAVERSAL:
        encoded = encoded | p.contains(text)
    system = F.lit(False)
    for folder in fv.SYSTEM_DIRS:
        system = system | (tidy == folder) | tidy.startswith(folder + "/")
    kind = (
        F.when(p.contains("..") | p.contains("~"), "traversal")
        .when(encoded, "encoded_traversal")
        .when(name.rlike(reserved), "reserved_name")
        .when(name.startswith(".") & ~name.isin(fv.ALLOWED_HIDDEN), "hidden")
        .when(system, "system_directory")
        .when(F.octet_length(tidy) > fv.MAX_PATH, "too_long")
        .when(tidy.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), "control_character")
        .otherwise("ok")
    )
    return df.withColumn("path_class", kind)


_JOINT = "\u0001"  # between joined arguments; where an argument holds it, all are looked at one by one


def classify_commands(df: DataFrame, command: str = "command", args: str = "args") -> DataFrame:
    """Add ``command_class``: the first failing check, or ``ok``.

    Order: denied command, then every argument in turn, then the allow list,
    then private hosts for download commands and remote git operations.
    """
    c, a = F.col(command), F.col(args)
    word = rf"(?<![\p{{IsAlphabetic}}\p{{N}}]){_any_of(fv.DENIED_ARGUMENT_WORDS)}(?![\p{{IsAlphabetic}}\p{{N}}])"
    meta = _any_of(fv.SHELL_METACHARACTERS)
    places = _any_of(fv.ARGUMENT_SYSTEM_PATHS)

    def argument(x: Column) -> Column:
        return (
            F.when(x.rlike(meta), "metacharacter")
            .when(x.rlike(word), "denied_word")
            .when(x.rlike(places), "system_path")
            .when(x.contains("..") | x.contains("~"), "traversal")
        )

    # one search in the joined arguments finds the first that fails any check; only that one is classified
    single = "".join(_quote(w) for w in fv.SHELL_METACHARACTERS if len(w) == 1)
    longer = [w for w in (*fv.SHELL_METACHARACTERS, "..") if len(w) > 1]
    anything = rf"[{single}~]|{_any_of(longer)}|{word}|{places}"
    joints = lambda text: F.char_length(text) - F.char_length(F.replace(text, F.lit(_JOINT), F.lit("")))
    given = df.withColumn("_given", F.filter(a, lambda x: x.isNotNull())).withColumn("_joined", F.array_join("_given", _JOINT))
    searched = given.withColumn("_at", F.regexp_instr("_joined", F.lit(anything)))
    each = F.try_element_at(F.filter(F.transform("_given", argument), lambda v: v.isNotNull()), F.lit(1))
    place = joints(F.substring("_joined", F.lit(1), F.col("_at") - 1)) + 1
    suspect = searched.withColumn("_suspect", F.when(F.col("_at") > 0, F.try_element_at("_given", place)))
    marked = suspect.withColumn("_found", F.when(F.col("_at") == 0, F.lit(None).cast("string")).when(
        joints(F.col("_joined")) == F.size("_given") - 1, argument(F.col("_suspect"))).otherwise(each))
    found = F.col("_found")
    base = F.lower(file_name(c))
    private = F.exists(
        a, lambda x: x.rlike("^https?://") & x.rlike(_any_of(fv.PRIVATE_HOST_TEXT))
    )
    remote = F.lower(F.try_element_at(a, F.lit(1))).isin(fv.REMOTE_GIT_OPS)
    kind = (
        F.when(c.isin(fv.DENIED_COMMANDS), "denied_command")
        .when(found.isNotNull(), found)
        .when(~base.isin(fv.ALLOWED_COMMANDS), "not_allowed")
        .when(base.isin("curl", "wget") & private, "private_host")
        .when((base == "git") & remote, "remote_git")
        .otherwise("ok")
    )
    return marked.withColumn("command_class", kind).drop("_given", "_joined", "_at", "_suspect", "_found")


def classify_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``url_class``: bad_scheme, invalid, localhost, private_ip, private_host, too_long or ok."""
    u = F.col(url)
    host = F.lower(F.regexp_extract(u, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    four = bare.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$") & ~bare.endswith(".")
    octet = lambda i: F.split_part(bare, F.lit("."), F.lit(i)).try_cast("int")
    private4 = four & (
        (octet(1) == 10)
        | ((octet(1) == 172) & octet(2).between(16, 31))
        | ((octet(1) == 192) & (octet(2) == 168))
        | ((octet(1) == 169) & (octet(2) == 254))
        | (octet(1) == 127)
    )
    private6 = host.startswith("[") & bare.rlike("^(?:f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):")
    kind = (
        F.when(~u.rlike("^https?://"), "bad_scheme")
        .when(host == "", "invalid")
        .when((bare == "localhost") | bare.startswith("127.") | bare.startswith("::1"), "localhost")
        .when(private4 | private6, "private_ip")
        .when(bare.endswith(".local") | bare.endswith(".internal") | (bare == "broadcasthost"), "private_host")
        .when(F.octet_length(u) > 2048, "too_long")
        .otherwise("ok")
    )
    return df.withColumn("url_class", kind)
