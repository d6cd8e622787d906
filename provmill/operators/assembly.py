"""Conversations from log entries: chains of segments, turns, tool results.

``entries`` are those of sources.logs, with path_id and pos where said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provmill.functions import text as X
from provmill.operators import chains as K
from provmill.operators import conversations as C
from provmill.operators.dag import cut, stored


def chained_entries(entries: DataFrame, first_ids: DataFrame) -> DataFrame:
    """Entries of whole conversations: path_id (project and head), chain_ord, pos.

    In a chain of several segments, entries that carry another session's id
    bridge from it and are dropped; a segment alone keeps all of its entries.
    """
    key = lambda c: F.concat_ws("/", "project", c)
    entries = stored(entries)  # parsed once; the names of segments are read from it by themselves
    ids = first_ids.select(key("segment").alias("segment"), key("session_id").alias("session_id"))
    segments = cut(entries.select(key("segment").alias("segment")).distinct())
    known = segments.select(F.col("segment").alias("pred"))
    links = cut(K.links(ids).join(known, "pred", "left_semi"))
    chain = cut(K.chains(segments, links).select(F.col("segment").alias("__segment"), F.col("head").alias("path_id"), F.col("ord").alias("chain_ord")))
    size = chain.groupBy("path_id").agg(F.count("*").alias("n_segments"))
    e = entries.withColumn("__segment", key("segment")).join(chain, "__segment").join(size, "path_id")
    bridge = (F.col("session_id") != "") & (F.col("session_id") != F.col("segment"))
    kept = e.where((F.col("n_segments") == 1) | ~F.coalesce(bridge, F.lit(False)))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("path_id").orderBy("chain_ord", "line_no")) - 1).drop("__segment")


def is_result_only(text: Column | str = "text") -> Column:
    """A user entry with tool results and no text."""
    return (F.col("role") == "user") & (F.col("text") == "") & (F.size("tool_results") > 0)


def _said(entries: DataFrame) -> DataFrame:
    """Entries with a message, and whether they only have late results; read once, what follows takes some columns each."""
    return stored(entries.where("has_message").withColumn("__late", is_result_only()))


def _paired(said: DataFrame) -> DataFrame:
    """(path_id, pos, use) of every call, with its result."""
    calls = said.where("not __late").select("path_id", "pos", F.posexplode("tool_uses").alias("ord", "call"), "tool_results")
    inline = F.get(F.filter("tool_results", lambda r: r["id"] == F.col("call.id")), 0)
    answer = "struct<id:string,content:string,is_error:boolean>"
    calls = calls.select("path_id", F.col("call.id").alias("id"), F.lit(0).alias("kind"), "pos", "ord", inline.isNotNull().alias("done"), inline.cast(answer).alias("r"), F.col("call.name").alias("name"), F.col("call.input").alias("input"))
    late = said.where("__late and path_id is not null").select("path_id", "pos", F.posexplode("tool_results").alias("ord", "r")).select("path_id", F.col("r.id").alias("id"), F.lit(1).alias("kind"), "pos", "ord", F.lit(True).alias("done"), F.col("r").cast(answer).alias("r"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"))
    # calls and late results of one id meet in one shuffle; with an id that is unique, a call's result is the first later one
    of_id = Window.partitionBy("path_id", "id")
    before = of_id.orderBy(F.desc("pos"), "kind", F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)  # backwards, so a row takes one step
    next_late = F.last(F.when(F.col("kind") == 1, F.struct("pos", "r")), ignorenulls=True).over(before)
    met = calls.unionByName(late).withColumns({"__calls": F.count_if(F.col("kind") == 0).over(of_id), "__next": next_late})
    met = stored(met.where("kind = 0 or __calls > 1"))

    def pair(pdf):
        """Results in order; each goes to the newest open call."""
        import pandas as pd

        open_, out = [], []
        for row in pdf.sort_values(["pos", "ord"]).to_dict("records"):
            if row["kind"] == 0:
                if not row["done"]:
                    open_.append(row)
            elif open_:
                newest = max(c["pos"] for c in open_)
                call = next(c for c in open_ if c["pos"] == newest)
                open_.remove(call)
                out.append((call["path_id"], call["pos"], call["ord"], row["r"]["content"], row["r"]["is_error"]))
        return pd.DataFrame(out, columns=["path_id", "pos", "ord", "content", "is_error"])

    found = met.where("kind = 0")
    plain = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.col(f"{r}.content").alias("content"), F.col(f"{r}.is_error").alias("is_error")))
    late_of_one = plain("__next.r")
    several = met.where("__calls > 1")
    if several.isEmpty():
        with_kind = found.withColumn("result", F.coalesce(plain("r"), late_of_one))
    else:
        paired = several.select("path_id", "id", "kind", "pos", "ord", "done", "r").groupBy("path_id", "id").applyInPandas(pair, "path_id string, pos int, ord int, content string, is_error boolean")
        paired = paired.select("path_id", "pos", "ord", F.struct("content", "is_error").alias("paired"))
        with_kind = found.join(paired, ["path_id", "pos", "ord"], "left").withColumn("result", F.coalesce(plain("r"), F.when(F.col("__calls") > 1, F.col("paired")).otherwise(late_of_one)))
    return with_kind.select("path_id", "pos", F.struct(F.col("ord").alias("call_pos"), "id", "name", "input", "result", X.tool_category("name").alias("category")).alias("use"))


def turns(entries: DataFrame) -> DataFrame:
    """Turns of conversations, tool results put with their calls, and environment: where a turn was said, null where nothing tells.

    ``entries`` have path_id and pos.  A call's result is the first of its own
    message with its id; else the first later result-only entry's, which goes
    to the newest turn before it that has a call of that id without a result.
    Such entries are no turns.  A result before its call, or beside text, stays
    where it is.
    """
    said = _said(entries)
    per_turn = _paired(said).groupBy("path_id", "pos").agg(F.array_sort(F.collect_list("use")).alias("uses"))
    base = said.where("not __late").drop("tool_uses", "parts", "tool_results", "__late").join(per_turn, ["path_id", "pos"], "left")
    none = F.array().cast(per_turn.schema["uses"].dataType)
    return base.withColumn("tool_uses", F.coalesce("uses", none)).drop("uses").withColumns({"turn_id": F.col("uuid"), "environment": F.when(F.coalesce("cwd", "git_branch").isNotNull(), F.struct(F.col("cwd").alias("working_dir"), F.col("git_branch").alias("branch")))})


def calls_of(entries: DataFrame) -> DataFrame:
    """tool_calls(turns(entries)) where nothing else of the turns is asked for: only what calls need is made of the entries."""
    said = _said(entries.select("path_id", "pos", "has_message", "role", "text", "tool_uses", "tool_results"))
    return _paired(said).select("path_id", "pos", "use.*")


def tool_calls(turns: DataFrame) -> DataFrame:
    """path_id, pos, call_pos, id, name, input, result, category of every call."""
    return turns.select("path_id", "pos", F.explode("tool_uses").alias("u")).select("path_id", "pos", "u.*")


def delegations(turns: DataFrame) -> DataFrame:
    """(path_id, pos, agent_id, prompt, result) of every delegated task."""
    return tool_calls(turns).where("category = 'delegation'").select("path_id", "pos", F.col("id").alias("agent_id"), F.coalesce(_string("input", "$.prompt"), F.lit("")).alias("prompt"), F.col("result.content").alias("result"))


def _string(column: str, path: str) -> Column:
    """A JSON field that is a string; null for other kinds."""
    v = F.try_variant_get(F.try_parse_json(column), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(column), path, "string"))


def files_changed(turns: DataFrame) -> DataFrame:
    """(path_id, file, ord): written files in the order of first touch."""
    calls = tool_calls(turns).where("category = 'file_write'").select("path_id", "pos", "call_pos", _string("input", "$.file_path").alias("file"))
    return C.first_touch(calls)


def views(turns: DataFrame) -> DataFrame:
    """One row a conversation: bounds, number of turns, usage, files in order of first touch."""
    files = files_changed(turns).groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "file"))), lambda x: x["file"]).alias("files_changed"))
    seen = turns.groupBy("path_id").agg(F.min("at").alias("started_at"), F.max("at").alias("last_activity"), F.count("*").alias("n_turns"))
    return seen.join(C.usage(turns), "path_id", "left").join(files, "path_id", "left").withColumn("files_changed", F.coalesce("files_changed", F.array().cast("array<string>")))


def chain_metadata(metadata: DataFrame, first_ids: DataFrame) -> DataFrame:
    """head, message_count, started_at, last_activity, n_segments, first_segment of each chain; segments without times don't reset the bounds."""
    return _chain_of(metadata, first_ids).groupBy("head").agg(F.sum("message_count").alias("message_count"), F.min("started_at").alias("started_at"), F.max("last_activity").alias("last_activity"), F.count("*").alias("n_segments"), F.min_by("segment", "ord").alias("first_segment"))


def _chain_of(metadata: DataFrame, first_ids: DataFrame) -> DataFrame:
    """Metadata of segments with the head of their chain and their place in it."""
    key = lambda c: F.concat_ws("/", "project", c)
    segments = cut(metadata.select(key("segment").alias("segment"), "message_count", "started_at", "last_activity"))  # a row a segment
    known = segments.select(F.col("segment").alias("pred"))
    links = cut(K.links(first_ids.select(key("segment").alias("segment"), key("session_id").alias("session_id"))).join(known, "pred", "left_semi"))
    return K.chains(segments, links).join(segments, "segment")


def merged_bounds(entries: DataFrame, metadata: DataFrame, first_ids: DataFrame) -> DataFrame:
    """head, started_at and last_activity of each chain, as a merged conversation has them.

    started_at is that of the first segment that has one, or of an earlier entry
    that is kept; last_activity that of the last segment that has one.
    ``entries`` are those of chained_entries().
    """
    chain = _chain_of(metadata, first_ids)
    of = chain.groupBy("head").agg(F.min_by("started_at", F.when(F.col("started_at").isNotNull(), F.col("ord"))).alias("first"), F.max_by("last_activity", F.when(F.col("last_activity").isNotNull(), F.col("ord"))).alias("last_activity"))
    kept = entries.groupBy(F.col("path_id").alias("head")).agg(F.min("at").alias("earliest"))
    return of.join(kept, "head", "left").select("head", F.least("first", "earliest").alias("started_at"), "last_activity")


def conversation_messages(entries: DataFrame, role: str) -> DataFrame:
    """Entries whose kind and whose message's role both are ``role``."""
    return entries.where((F.col("type") == role) & (F.col("role") == role))


def find_conversations(entries: DataFrame, search: str) -> DataFrame:
    """(path_id, last_activity) of conversations with ``search`` in an entry, the latest first, those without times last."""
    seen = entries.where("path_id is not null").groupBy("path_id").agg(F.max("at").alias("last_activity"), F.bool_or(F.coalesce(_has_text(search), F.lit(False))).alias("__hit"))
    return seen.where("__hit").drop("__hit").orderBy(F.desc_nulls_last("last_activity"), "path_id")


def errors(entries: DataFrame) -> DataFrame:
    """Entries with a failed tool result."""
    return entries.where(F.exists("tool_results", lambda r: r["is_error"]))


def uses_tool(entries: DataFrame, name: str) -> DataFrame:
    return entries.where(F.exists("tool_uses", lambda u: u["name"] == name))


def _has_text(search: str) -> Column:
    low = F.lower(F.lit(search))
    hit = lambda s: F.contains(F.lower(s), low)
    return F.exists("parts", lambda p: ((p["type"] == "text") & hit(p["text"])) | ((p["type"] == "tool_result") & hit(p["content"])))


def with_text(entries: DataFrame, search: str) -> DataFrame:
    """Entries whose text or tool results hold ``search``, whatever the case; an empty search takes all that have either."""
    return entries.where(_has_text(search))
