"""Conversation logs: JSON lines, one entry a line, one file a session segment.

Layout: <root>/projects/<project>/<segment>.jsonl and <root>/history.jsonl.
Blank lines are skipped; lines that can't be read are rejected one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provmill.functions import text as X
from provmill.sources.documents import _default, _is, _optional, _v, once

#: Lines looked at for a segment's first session id.
FIRST_LINES = 10


def project_dir(root: str, project: str) -> str:
    return f"{root.rstrip('/')}/projects/{project.replace('/', '-').replace('_', '-')}"


def history_file(root: str) -> str:
    return f"{root.rstrip('/')}/history.jsonl"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """project, segment, file, file_size, line_no, line: physical lines in order, blank ones too."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"))
    split = files.select("file", "file_size", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    at = lambda i: F.element_at(F.split("file", "/"), i)
    return split.select(at(-2).alias("project"), F.regexp_replace(at(-1), r"\.jsonl$", "").alias("segment"), "file", "file_size", "line_no", "line")


def _text(v: Column, path: str) -> Column:
    """A string field; null if it is something else."""
    found = _v(v, path)
    return F.when(_is(found, "STRING"), _v(v, path, "string"))


#: What is looked at of a content part and of an entry, taken out by one cast each; fields whose kind has to be told stay variants.
LOOK_PART = "struct<type:variant,text:variant,thinking:variant,signature:variant,id:variant,name:variant,input:variant,tool_use_id:variant,content:variant,is_error:variant>"
LOOK = "struct<type:variant,uuid:variant,timestamp:variant,isSidechain:variant,sessionId:variant,parentUuid:variant,cwd:variant,gitBranch:variant,version:variant,userType:variant,requestId:variant,messageId:variant,message:struct<role:variant,model:variant,stop_reason:variant,stopReason:variant,usage:variant>>"


def _said(v: Column) -> Column:
    """A variant that is a string; null if it is something else."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _bad_part(p: Column) -> Column:
    kind = _said(p["type"])
    text = lambda f: _is(p[f], "STRING")
    return (
        kind.isNull()
        | (kind == "text") & ~text("text")
        | (kind == "thinking") & (~text("thinking") | ~_optional(p["signature"], "STRING"))
        | (kind == "tool_use") & (~text("id") | ~text("name") | p["input"].isNull())
        | (kind == "tool_result") & (~text("tool_use_id") | ~_is(p["content"], "STRING", "ARRAY") | ~_default(p["is_error"], "BOOLEAN"))
    )


def _error(v: Column, e: Column, parts: Column) -> Column:
    """Why an entry can't be read, or null; an unknown kind of content part is no error."""
    m, usage = e["message"], e["message"]["usage"]
    bad_count = F.lit(False)
    for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"):
        bad_count = bad_count | ~_optional(_v(usage, f"$.{c}"), "BIGINT")
    bad_optional = F.lit(False)
    for c in ("sessionId", "parentUuid", "cwd", "gitBranch", "version", "userType", "requestId", "messageId"):
        bad_optional = bad_optional | ~_optional(e[c], "STRING")
    return (
        F.when(v.isNull(), "not JSON")
        .when(e.isNull(), "not an object")
        .when(~_is(e["type"], "STRING"), "type")
        .when(~_default(e["uuid"], "STRING"), "uuid")
        .when(~_default(e["timestamp"], "STRING"), "timestamp")
        .when(~_default(e["isSidechain"], "BOOLEAN"), "isSidechain")
        .when(bad_optional, "optional field")
        .when(m.isNull() & ~_optional(_v(v, "$.message"), "VOID"), "message")
        .when(m.isNotNull() & ~F.coalesce(_said(m["role"]).isin("user", "assistant", "system"), F.lit(False)), "message.role")
        .when(parts.isNull() & ~_optional(_v(v, "$.message.content"), "STRING"), "message.content")
        .when(F.exists(parts, _bad_part), "message.content part")
        .when(usage.isNotNull() & (~_optional(usage, "OBJECT") | bad_count), "message.usage")
    )


#: Fields of an entry that have a column of their own (fixed values).
FIELDS = ("parentUuid", "isSidechain", "type", "uuid", "timestamp", "sessionId", "cwd", "gitBranch", "version", "message", "userType", "requestId", "toolUseResult", "snapshot", "messageId")


def _extra(v: Column) -> Column:
    """The fields without a column of their own, as an object; null if there are none."""
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: ~k.isin(*FIELDS))
    return F.when(F.exists(F.map_keys(F.try_variant_get(v, "$", "map<string,boolean>")), lambda k: ~k.isin(*FIELDS)), F.to_variant_object(rest))


RESULT = "struct<id:string,content:string,is_error:boolean>"
PART = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>"


def _result_text(p: Column) -> Column:
    """A result's text: itself, or its parts' texts by line."""
    several = F.array_join(F.transform(F.try_variant_get(p["content"], "$", "array<struct<text:variant>>"), lambda x: _said(x["text"])), "\n")
    return F.when(_is(p["content"], "STRING"), F.try_variant_get(p["content"], "$", "string")).otherwise(several)


def _part(p: Column) -> Column:
    kind = _said(p["type"])
    known = F.when(kind.isin("text", "thinking", "tool_use", "tool_result"), kind).otherwise("unknown")
    return F.struct(
        known.alias("type"), F.when(kind == "text", _said(p["text"])).alias("text"), F.when(kind == "thinking", _said(p["thinking"])).alias("thinking"), F.when(kind == "tool_use", _said(p["id"])).alias("id"), F.when(kind == "tool_use", _said(p["name"])).alias("name"),
        F.when(kind == "tool_use", F.to_json(p["input"])).alias("input"), F.when(kind == "tool_result", _said(p["tool_use_id"])).alias("tool_use_id"), F.when(kind == "tool_result", _result_text(p)).alias("content"), F.when(kind == "tool_result", F.coalesce(F.try_variant_get(p["is_error"], "$", "boolean"), F.lit(False))).alias("is_error"),
    )


def entries(raw: DataFrame, bad: bool = False) -> DataFrame:
    """The readable entries of lines(), or (``bad``) the lines that can't be read with the reason.

    What an entry has beside the known fields is in ``extra``, a variant.  Entries with an empty uuid are left out.  A message's text is its text parts
    by line; a plain string is one text part.
    """
    v = once(raw.where(F.col("line").rlike(r"\S")), F.try_parse_json("line").alias("v"))
    v = once(v, _v("v", "$", LOOK).alias("e"), _v("v", "$.message.content", f"array<{LOOK_PART}>").alias("looked"))
    v = once(v, _error(F.col("v"), F.col("e"), F.col("looked")).alias("error"))
    if bad:
        return v.where("error is not null").select("project", "segment", "file", "line_no", "error")
    ok = v.where("error is null")
    one = F.array(F.struct(F.lit("text").alias("type"), _v("v", "$.message.content", "string").alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("thinking", "id", "name", "input", "tool_use_id", "content")), F.lit(None).cast("boolean").alias("is_error")))
    none = F.array().cast(f"array<{PART}>")
    parts = F.when(F.col("looked").isNotNull(), F.transform("looked", _part).cast(f"array<{PART}>")).when(_is(_v("v", "$.message.content"), "STRING"), one.cast(f"array<{PART}>")).otherwise(none)
    ok = once(ok, parts.alias("parts"))
    m = F.col("e.message")
    count_of = lambda *names: F.coalesce(*(_v(m["usage"], f"$.{n}", "bigint") for n in names))
    usage = F.when(
        _is(m["usage"], "OBJECT"),
        F.struct(count_of("input_tokens", "inputTokens").alias("input_tokens"), count_of("output_tokens", "outputTokens").alias("output_tokens"), count_of("cache_read_input_tokens", "cacheReadInputTokens").alias("cache_read_tokens"), count_of("cache_creation_input_tokens", "cacheCreationInputTokens").alias("cache_write_tokens")),
    )
    said = lambda name: _said(F.col(f"e.{name}"))
    e = ok.select(
        "project", "segment", "file", "line_no", F.coalesce(said("uuid"), F.lit("")).alias("uuid"), said("parentUuid").alias("parent_uuid"), F.coalesce(F.try_variant_get("e.isSidechain", "$", "boolean"), F.lit(False)).alias("is_sidechain"), said("type").alias("type"),
        F.coalesce(said("timestamp"), F.lit("")).alias("ts"), said("sessionId").alias("session_id"), said("cwd").alias("cwd"), said("gitBranch").alias("git_branch"), m.isNotNull().alias("has_message"), said("message.role").alias("role"),
        said("message.model").alias("model"), F.coalesce(said("message.stop_reason"), said("message.stopReason")).alias("stop_reason"), "parts", usage.alias("usage"),
        *(said(name).alias(column) for name, column in (("version", "version"), ("userType", "user_type"), ("requestId", "request_id"), ("messageId", "message_id"))), _v("v", "$.toolUseResult").alias("tool_use_result"), _v("v", "$.snapshot").alias("snapshot"), _extra(F.col("v")).alias("extra"),
    )
    of = lambda kind: F.filter("parts", lambda p: p["type"] == kind)
    joined = lambda kind, field: F.array_join(F.transform(of(kind), lambda p: p[field]), "\n")
    e = e.withColumn("text", joined("text", "text")).withColumn("thinking", F.when(F.size(of("thinking")) > 0, joined("thinking", "thinking")))
    e = e.withColumn("tool_uses", F.transform(of("tool_use"), lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["input"].alias("input"))))
    e = e.withColumn("tool_results", F.transform(of("tool_result"), lambda p: F.struct(p["tool_use_id"].alias("id"), p["content"].alias("content"), p["is_error"].alias("is_error"))))
    return e.withColumn("at", F.try_to_timestamp("ts")).where("uuid <> ''")


def first_session_ids(raw: DataFrame, n: int = FIRST_LINES) -> DataFrame:
    """(project, segment, session_id): the first session id within a segment's first lines."""
    sid = F.get_json_object("line", "$.sessionId")
    return raw.where(F.col("line_no") < n).select("project", "segment", "line_no", sid.alias("session_id")).where("session_id <> ''").groupBy("project", "segment").agg(F.min_by("session_id", "line_no").alias("session_id"))


def from_offset(path_bytes: bytes, offset: int) -> tuple[list[str], int]:
    """Complete lines after a byte offset and the offset of what wasn't read; past the end: nothing, and the end.

    A last line without its line end stays for the next time.
    """
    if offset > len(path_bytes):
        return [], len(path_bytes)
    rest = path_bytes[offset:]
    end = rest.rfind(b"\n") + 1
    return [x for x in rest[:end].decode("utf-8", "replace").splitlines() if x.strip()], offset + end


def history(spark: SparkSession, path: str) -> DataFrame:
    """display, timestamp (ms), project, session_id, pos; lines that can't be read are left out, a missing file is empty."""
    from pyspark.errors import AnalysisException

    try:
        return history_lines(lines(spark, path))
    except AnalysisException:
        return spark.createDataFrame([], "display string, timestamp long, project string, session_id string, pos int")


def history_lines(raw: DataFrame) -> DataFrame:
    """history() of lines at hand: line_no, line."""
    v = raw.where(F.col("line").rlike(r"\S")).select(F.col("line_no").alias("pos"), F.try_parse_json("line").alias("v"))
    ok = _is(_v("v", "$.display"), "STRING") & _is(_v("v", "$.timestamp"), "BIGINT") & _optional(_v("v", "$.project"), "STRING") & _optional(_v("v", "$.sessionId"), "STRING")
    return v.where(ok).select(_v("v", "$.display", "string").alias("display"), _v("v", "$.timestamp", "bigint").alias("timestamp"), _text(F.col("v"), "$.project").alias("project"), _text(F.col("v"), "$.sessionId").alias("session_id"), "pos")


def metadata(raw: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """project, segment, file, message_count, started_at, last_activity, cwd of each segment.  ``e``: the entries of ``raw``, where they are at hand."""
    e = entries(raw) if e is None else e
    seen = e.groupBy("project", "segment", "file").agg(F.count_if("has_message").alias("message_count"), F.min("at").alias("started_at"), F.max("at").alias("last_activity"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"))
    files = raw.select("project", "segment", "file").distinct()
    return files.join(seen, ["project", "segment", "file"], "left").na.fill({"message_count": 0})


def summary(part: Column) -> Column:
    """A content part in a few words."""
    cut = lambda s, n: X.truncate(s, n)
    return (
        F.when(part["type"] == "text", cut(part["text"], 100))
        .when(part["type"] == "thinking", "[thinking]")
        .when(part["type"] == "tool_use", F.concat(F.lit("[tool_use: "), part["name"], F.lit("]")))
        .when(part["type"] == "tool_result", F.concat(F.lit("["), F.when(part["is_error"], "error").otherwise("result"), F.lit(": "), cut(part["content"], 80), F.lit("]")))
        .otherwise("[unknown]")
    )


def positions(e: DataFrame) -> DataFrame:
    """Entries with pos: their place in the segment."""
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("project", "segment").orderBy("line_no")) - 1)


def projects(raw: DataFrame) -> DataFrame:
    """(project) of all logs, each once."""
    return raw.select("project").distinct()


def segments(raw: DataFrame) -> DataFrame:
    """(project, segment) of all logs, each once."""
    return raw.select("project", "segment").distinct()


def conversations(raw: DataFrame, first_ids: DataFrame) -> DataFrame:
    """(project, segment) of the segments that continue no other one of their project."""
    own = segments(raw)
    known = own.select("project", F.col("segment").alias("session_id"))
    later = first_ids.where("session_id <> '' and session_id <> segment").join(known, ["project", "session_id"], "left_semi").select("project", "segment")
    return own.join(later, ["project", "segment"], "left_anti")


def segment(raw: DataFrame, project: str, name: str) -> DataFrame:
    """The lines of one segment, no chain followed."""
    return raw.where((F.col("project") == project) & (F.col("segment") == name))


def exists(raw: DataFrame, project: str, name: str | None = None) -> bool:
    """Whether there is such a project, or such a segment of it."""
    found = raw.where(F.col("project") == project)
    return not (found if name is None else found.where(F.col("segment") == name)).isEmpty()


def listing(metadata: DataFrame) -> DataFrame:
    """Metadata, the latest first; segments without times last."""
    return metadata.orderBy(F.desc_nulls_last("last_activity"), "project", "segment")


def by_type(e: DataFrame, kind: str) -> DataFrame:
    return e.where(F.col("type") == kind)


def between(e: DataFrame, start: str, end: str) -> DataFrame:
    """Entries with a readable time from start to end, both included."""
    return e.where(F.col("at").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def history_of(h: DataFrame, project: str | None = None, session: str | None = None, start: int | None = None, end: int | None = None, search: str | None = None) -> DataFrame:
    """History lines of a project, a session, times (milliseconds, both ends included) and a text, whatever its case; null never matches."""
    if project is not None:
        h = h.where(F.col("project") == project)
    if session is not None:
        h = h.where(F.col("session_id") == session)
    if start is not None:
        h = h.where(F.col("timestamp") >= start)
    if end is not None:
        h = h.where(F.col("timestamp") <= end)
    return h if search is None else h.where(F.contains(F.lower("display"), F.lower(F.lit(search))))
