"""Saved editing sessions: Path documents whose meta.track has the editor's state.

A session file is readable like any other document; export leaves the state out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provmill.sources import documents as D
from provmill.sources.documents import _field, _is, _object, _v


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, raw) of the session files of a folder."""
    return D.read(spark, f"{folder.rstrip('/')}/track-*.json")


def _sessions(documents: DataFrame) -> DataFrame:
    """Readable Path documents that have a state; all others are left out without a word."""
    return D.parse(documents).where("error is null and kind = 'Path'").where(_is(_v("body", "$.meta.track"), "OBJECT"))


def listing(documents: DataFrame) -> DataFrame:
    """uri, session_id, file, actor, n_steps, created_at of each session."""
    state = lambda f: _v("body", f"$.meta.track.{f}", "string")
    return _sessions(documents).select("uri", F.col("id").alias("session_id"), state("file").alias("file"), state("default_actor").alias("actor"), F.size(_v("body", "$.steps", "array<variant>")).alias("n_steps"), state("created_at").alias("created_at"))


def _document(meta: Column) -> Column:
    return F.concat(F.lit('{"Path":'), _object(_field("path", F.to_json(_v("body", "$.path"))), _field("steps", F.to_json(_v("body", "$.steps"))), _field("meta", meta)), F.lit("}"))


def export(documents: DataFrame) -> DataFrame:
    """(uri, session_id, raw): the sessions as plain documents; a meta with nothing but the state goes with it."""
    rest = F.map_filter(_v("body", "$.meta", "map<string,variant>"), lambda k, _: k != "track")
    return _sessions(documents).select("uri", F.col("id").alias("session_id"), _document(F.when(F.size(rest) > 0, F.to_json(rest))).alias("raw"))


def with_state(documents: DataFrame, state: Column) -> DataFrame:
    """(uri, raw): Path documents with a state (JSON text) put into meta.track; where the state is null a document, whatever it is, stays as it was and isn't parsed."""
    given = documents.select("uri", F.col("raw").alias("__whole"), state.alias("__state"))
    d = D.parse(given.withColumn("raw", F.when(F.col("__state").isNotNull(), F.col("__whole")))).where("__state is null or error is null and kind = 'Path'")
    meta = F.map_filter(F.coalesce(_v("body", "$.meta", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: k != "track")
    made = _document(F.to_json(F.map_concat(meta, F.create_map(F.lit("track"), F.parse_json("__state")))))
    return d.select("uri", F.when(F.col("__state").isNull(), F.col("__whole")).otherwise(made).alias("raw"))


def save(documents: DataFrame, folder: str) -> None:
    """Write documents (uri, raw) to a folder of compressed text, a line each; they are all there or none is.  Nothing else stays on the disk."""
    from provmill.operators.dag import freed

    with freed(documents.sparkSession):
        documents.select("raw").write.mode("overwrite").option("compression", "gzip").text(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, raw) of documents that save() wrote; a document's uri is its id."""
    return spark.read.text(folder).select(F.coalesce(*(F.get_json_object("value", f"$.{kind}.{kind.lower()}.id") for kind in D.KINDS)).alias("uri"), F.col("value").alias("raw"))


def close(documents: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """(the session as a plain document, the documents that stay)."""
    gone = _sessions(documents).where(F.col("id") == session_id).select("uri")
    return export(documents).where(F.col("session_id") == session_id), documents.join(gone, "uri", "left_anti")
