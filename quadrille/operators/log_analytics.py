"""Analytics of log tables (labels, ts_ns, line, metadata): labels, volumes, patterns, detected fields, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import labels_of, matches
from ..plans import logql


def bucket(ms: int) -> Column:
    return F.call_function("div", F.call_function("div", F.col("ts_ns"), F.lit(1_000_000)), F.lit(ms)) * ms


def label_values(logs: DataFrame) -> DataFrame:
    return logs.select(F.explode("labels").alias("name", "value")).distinct()


def series(logs: DataFrame) -> DataFrame:
    return logs.select(labels_of(F.col("labels")).alias("ls")).distinct().select(F.map_from_entries("ls").alias("labels"))


def index_stats(logs: DataFrame) -> DataFrame:
    """Sums by stream first, so that the last step has a row for each stream."""
    by = logs.groupBy(labels_of(F.col("labels")).alias("ls")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("b"))
    return by.agg(F.count(F.lit(1)).alias("streams"), F.sum("n").alias("entries"), F.sum("b").alias("bytes"))


def volume(logs: DataFrame, names: list[str], step_ms: int) -> DataFrame:
    keys = [F.col("labels")[n].alias(n) for n in names]
    return logs.groupBy(*keys, bucket(step_ms).alias("bucket_ms")).agg(F.sum(F.octet_length("line")).cast("long").alias("bytes"))


def varies(token: Column) -> Column:
    """Whether a token is data: it begins with a digit, is a number, a uuid, 16 or more hexadecimal digits, or 16 or more letters and digits with some of both."""
    bare = F.regexp_replace(token, r'^"+|"+$', "")
    shapes = (
        r"^\d", r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$", r"^(?i)[+-]?(?:inf|infinity|nan)$", r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"^[0-9a-fA-F]{16,}$",
        r"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9]{16,}$",
    )
    return bare.rlike("|".join(f"(?:{x})" for x in shapes))


def token_pattern(token: Column) -> Column:
    """A token, or <_> in place of data; key=value keeps its key."""
    key, value = F.regexp_extract(token, r"(?s)^([^=]+=)(.+)$", 1), F.regexp_extract(token, r"(?s)^([^=]+=)(.+)$", 2)
    return F.when(F.instr(token, "=") > 0, F.when((key != "") & varies(value), F.concat(key, F.lit("<_>"))).otherwise(token)).when(varies(token), F.lit("<_>")).otherwise(token)


JSON_TOKEN = r'"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[\]{},]'


def json_pattern(line: Column) -> Column:
    """A JSON object with its keys, <_> for numbers and for the words of texts that are data; without white space between its parts."""
    words = lambda t: F.array_join(F.transform(F.filter(F.split(F.regexp_replace(t, r'^"|"$', ""), r"\s+"), lambda w: w != ""), lambda w: F.when(varies(w), F.lit("<_>")).otherwise(w)), " ")
    part = lambda t: F.when(t.rlike(r":$"), F.regexp_replace(t, r"\s+:$", ":")).when(t.startswith('"'), F.concat(F.lit('"'), words(t), F.lit('"'))).when(t.rlike(r"^[-\d]"), F.lit('"<_>"')).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(line, F.lit(JSON_TOKEN), 0), part), "")


def patterns(logs: DataFrame, step_ms: int) -> DataFrame:
    """(pattern, bucket_ms, n)."""
    words = F.array_join(F.transform(F.filter(F.split("line", r"\s+"), lambda w: w != ""), token_pattern), " ")
    text = F.when(F.col("line").rlike(r"^\s*\{") & F.from_json("line", logql.JSON_MAP).isNotNull(), json_pattern(F.col("line"))).otherwise(words)
    return logs.groupBy(text.alias("pattern"), bucket(step_ms).alias("bucket_ms")).agg(F.count(F.lit(1)).alias("n"))


def detected_fields(logs: DataFrame) -> DataFrame:
    """(field, type, cardinality) of logfmt or JSON fields."""
    found = F.coalesce(logql.json_fields(F.col("line")), logql.logfmt_fields(F.col("line")))
    pairs = logs.select(F.explode(found).alias("field", "v")).distinct()
    v = F.col("v")
    kind = (
        F.when(v.rlike("^(true|false)$"), "boolean").when(v.rlike(r"^[+-]?\d+$"), "int").when(logql.plain(v).isNotNull(), "float")
        .when(logql.seconds(v).isNotNull(), "duration").when(logql.size_bytes(v).isNotNull(), "bytes").otherwise("string")
    )
    typed = pairs.withColumn("kind", kind).groupBy("field").agg(F.collect_set("kind").alias("kinds"), F.count(F.lit(1)).alias("cardinality"))
    both = F.when(F.size("kinds") == 1, F.get("kinds", 0)).when(F.size(F.array_except("kinds", F.array(F.lit("int"), F.lit("float")))) == 0, "float").otherwise("string")
    return typed.select("field", both.alias("type"), "cardinality")


def without_deleted(logs: DataFrame, requests: list[tuple[str, int, int]]) -> DataFrame:
    """Rows that no delete request (selector with line filters, from ns, to ns) matches."""
    for text, low, high in requests:
        node = logql.parse(text)
        test = F.col("ts_ns").between(low, high)
        for k, op, v in node.matchers:
            test &= matches(F.col("labels")[k], op, v, absent_is_empty=False)
        for s in node.stages:
            if s.kind != "line":
                raise logql.QueryError("delete requests take line filters only")
            hit = F.lit(False)
            for want in s.args[1]:
                hit |= logql.line_test(s.args[0], want, F.col("line"))
            test &= ~hit if s.args[0][0] == "!" else hit
        logs = logs.filter(~test)
    return logs


def detected_labels(logs: DataFrame) -> DataFrame:
    """(label, cardinality) of the streams' labels; those that only hold ids, numbers or uuids, are left out."""
    pairs = logs.select(F.explode("labels").alias("label", "value")).distinct()
    ident = F.col("value").rlike(r"^\d+$|^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}$")
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("cardinality"), F.min(ident).alias("ids")).filter("not ids").select("label", "cardinality")


def detected_values(logs: DataFrame, field: str, limit: int = 1000) -> DataFrame:
    """(value) of one parsed field, metadata or label, the first ``limit`` in order."""
    found = F.coalesce(logql.json_fields(F.col("line")), logql.logfmt_fields(F.col("line")))
    value = F.coalesce(found[field], F.col("metadata")[field], F.col("labels")[field])
    return logs.select(value.alias("value")).filter("value is not null").distinct().orderBy("value").limit(limit)
