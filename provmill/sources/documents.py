"""Provenance documents: one JSON file each, tagged Step, Path or Graph.

Parsing is lenient as decoders with typed fields are: unknown keys are ignored,
a missing or mistyped required field rejects the whole document, and rejects are
kept with the reason.  Open parts (extra keys, structural changes) stay VARIANT
or JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REF = "array<struct<rel:string,href:string>>"
ACTOR = "struct<name:string,provider:string,model:string,identities:array<struct<system:string,id:string>>,keys:array<struct<type:string,fingerprint:string,href:string>>>"
SIGNATURE = "array<struct<signer:string,key:string,scope:string,sig:string,timestamp:string>>"
SOURCE = "struct<type:string,revision:string,change_id:string>"
STEP = f"struct<step:struct<id:string,parents:array<string>,actor:string,timestamp:string>,meta:struct<intent:string,source:{SOURCE},refs:{REF},actors:map<string,{ACTOR}>,signatures:{SIGNATURE}>>"

KINDS = ("Step", "Path", "Graph")
#: A step's parts as they are read, by one cast.
READ_STEP = "struct<step:struct<id:string,parents:array<string>,actor:string,timestamp:string>,change:map<string,struct<raw:string,structural:variant>>,meta:variant>"


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(uri, raw): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("raw"))


def from_text(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(uri, raw) of texts at hand, such as standard input."""
    return spark.createDataFrame([(f"text:{i}", t) for i, t in enumerate(texts)], "uri string, raw string")


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Rows with further columns, which are worked out once however often they are used.

    A filter on a column of a projection is pushed below it with a copy of the
    column's expression for each use; one on a generated column stays above.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _v(column: Column | str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(column) if isinstance(column, str) else column, path, kind)


def _is(column: Column, *kinds: str) -> Column:
    """Whether a variant is of one of the kinds; false where the field is absent.

    Objects and arrays are told by a cast that copies nothing of what is in them,
    where the schema of a variant looks at all of it.
    """
    casts = {"OBJECT": "map<string,boolean>", "ARRAY": "array<boolean>"}
    tests = [F.try_variant_get(column, "$", t).isNotNull() for k, t in casts.items() if k in kinds]
    plain = [k for k in kinds if k not in casts]
    if plain == ["VOID"]:
        tests.append(F.coalesce(F.is_variant_null(column), F.lit(False)))
    elif plain:
        tests.append(F.coalesce(F.schema_of_variant(column).isin(*plain), F.lit(False)))
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _optional(column: Column, *kinds: str) -> Column:
    """Absent, null or of the kind."""
    return column.isNull() | _is(column, "VOID", *kinds)


def _default(column: Column, *kinds: str) -> Column:
    """Absent or of the kind; null is an error."""
    return column.isNull() | _is(column, *kinds)


def _text(v: Column) -> Column:
    return _is(v, "STRING")


#: What is looked at of a step and of a path, taken out by one cast; a part of another kind than its type is null, one whose kind has to be told from an absent one stays a variant.
LOOK_STEP = "struct<step:struct<id:variant,parents:variant,actor:variant,timestamp:variant>,change:map<string,boolean>,meta:variant>"
LOOK_PATH = f"struct<`$ref`:variant,path:struct<id:variant,head:variant,base:variant>,steps:array<{LOOK_STEP}>,meta:variant>"


def _bad_step(s: Column) -> Column:
    """Why a step (LOOK_STEP) can't be read, or null."""
    parents = s["step"]["parents"]
    return (
        F.when(s["step"].isNull(), "step.step")
        .when(~_text(s["step"]["id"]), "step.id")
        .when(~_text(s["step"]["actor"]), "step.actor")
        .when(~_text(s["step"]["timestamp"]), "step.timestamp")
        .when(parents.isNotNull() & ~F.schema_of_variant(parents).isin("ARRAY<STRING>", "ARRAY<VOID>"), "step.parents")
        .when(s["change"].isNull(), "step.change")
        .when(~_optional(s["meta"], "OBJECT"), "step.meta")
    )


def _bad_path(p: Column) -> Column:
    """Why a path (LOOK_PATH) can't be read, or null."""
    base = p["path"]["base"]
    return (
        F.when(p["path"].isNull(), "path.path")
        .when(~_text(p["path"]["id"]), "path.id")
        .when(~_text(p["path"]["head"]), "path.head")
        .when(~_optional(base, "OBJECT"), "path.base")
        .when(_is(base, "OBJECT") & ~_text(_v(base, "$.uri")), "path.base.uri")
        .when(p["steps"].isNull(), "path.steps")
        .when(~_optional(p["meta"], "OBJECT"), "path.meta")
        .otherwise(F.get(F.filter(F.transform(p["steps"], _bad_step), lambda x: x.isNotNull()), 0))
    )


def _is_ref(v: Column) -> Column:
    return _text(_v(v, "$['$ref']"))


def _bad_graph(doc: Column) -> Column:
    paths = _v(doc, "$.Graph.paths", f"array<{LOOK_PATH}>")
    return (
        F.when(~_text(_v(doc, "$.Graph.graph.id")), "graph.id")
        .when(~_v(doc, "$.Graph.paths", "array<boolean>").isNotNull(), "graph.paths")
        .when(~_optional(_v(doc, "$.Graph.meta"), "OBJECT"), "graph.meta")
        .otherwise(F.get(F.filter(F.transform(paths, lambda p: F.when(~_text(p["$ref"]), _bad_path(p))), lambda x: x.isNotNull()), 0))
    )


def _parsed(documents: DataFrame) -> DataFrame:
    """Documents with doc (VARIANT, whole), kind, error and id; each is worked out once."""
    one = once(documents, F.try_parse_json("raw").alias("doc"))
    keys = F.when(F.col("doc").isNull(), F.json_object_keys("raw")).otherwise(F.map_keys(_v("doc", "$", "map<string,boolean>")))
    two = once(one, keys.alias("__keys"))
    kind = F.when(F.size("__keys") == 1, F.get("__keys", 0))
    three = once(two, F.when(kind.isin(*KINDS), kind).alias("kind")).drop("__keys")
    look = F.struct(F.when(F.col("kind") == "Step", _v("doc", "$.Step", LOOK_STEP)).alias("step"), F.when(F.col("kind") == "Path", _v("doc", "$.Path", LOOK_PATH)).alias("path"))
    four = once(three, look.alias("__look"))
    error = (
        F.when(F.col("doc").isNull(), "not JSON")
        .when(F.col("kind").isNull(), "not exactly one of Step, Path, Graph")
        .when(F.col("kind") == "Step", _bad_step(F.col("__look.step")))
        .when(F.col("kind") == "Path", _bad_path(F.col("__look.path")))
        .otherwise(_bad_graph(F.col("doc")))
    )
    id_ = F.when(F.col("kind") == "Step", _v("doc", "$.Step.step.id", "string")).when(F.col("kind") == "Path", _v("doc", "$.Path.path.id", "string")).otherwise(_v("doc", "$.Graph.graph.id", "string"))
    return once(four, error.alias("error"), id_.alias("id")).drop("__look")


def parse(documents: DataFrame) -> DataFrame:
    """uri, raw, kind, body (VARIANT), id, error of each document; error is null for one that can be read."""
    body = F.coalesce(*(_v("doc", f"$.{k}") for k in KINDS))
    return once(_parsed(documents), body.alias("body")).select(*documents.columns, "kind", "body", "error", "id")


def validate(documents: DataFrame) -> DataFrame:
    """uri, kind, id, n_steps, message: the verdict on each document."""
    d = _parsed(documents)
    n = F.coalesce(F.size(F.coalesce(*(_v("doc", f"$.{k}.steps", "array<boolean>") for k in KINDS))), F.lit(0))
    message = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Invalid: "), "error"))
        .when(F.col("kind") == "Graph", F.concat(F.lit("Valid: Graph ("), "id", F.lit(")")))
        .when(F.col("kind") == "Path", F.concat(F.lit("Valid: Path ("), "id", F.lit(", "), n.cast("string"), F.lit(" steps)")))
        .otherwise(F.concat(F.lit("Valid: Step ("), "id", F.lit(")")))
    )
    return d.select("uri", "kind", "id", F.when(F.col("kind") == "Path", n).alias("n_steps"), message.alias("message"))


def rejects(documents: DataFrame) -> DataFrame:
    return _parsed(documents).where("error is not null").select("uri", "error")


#: What names a path, as it is read.
PATH_NAMES = "struct<id:string,head:string,base:struct<uri:string,ref:string>>"


def _each_path(d: DataFrame, fields: str, alone, *more: str) -> DataFrame:
    """uri, graph_id, graph_actors, ``more`` columns, path_pos, ref_url and __path (a struct of ``fields``, by one cast) of every path; ``alone`` makes one of a step that stands alone."""
    kind, whole = F.col("kind"), f"struct<{fields}>"
    ref = lambda p: F.when(_text(p), F.try_variant_get(p, "$", "string"))
    refs = F.transform(_v("doc", "$.Graph.paths", "array<struct<`$ref`:variant>>"), lambda p: ref(p["$ref"]))
    of_graph = F.arrays_zip(refs.alias("ref_url"), _v("doc", "$.Graph.paths", f"array<{whole}>").alias("__path"))
    one = lambda p: F.array(F.struct(F.lit(None).cast("string").alias("ref_url"), p.alias("__path")))
    found = F.when(kind == "Graph", of_graph).when(kind == "Path", one(_v("doc", "$.Path", whole))).otherwise(one(alone(whole)))
    in_graph = kind == "Graph"
    return d.select("uri", F.when(in_graph, F.col("id")).alias("graph_id"), F.when(in_graph, _v("doc", "$.Graph.meta.actors")).alias("graph_actors"), *more, F.posexplode(found).alias("path_pos", "__p")).select("uri", "graph_id", "graph_actors", *more, "path_pos", "__p.ref_url", "__p.__path")


#: What a drawing shows of a step, by one cast.
DRAWN_STEP = "struct<step:struct<id:string,parents:array<string>,actor:string,timestamp:string>,change:map<string,boolean>,meta:struct<intent:string,source:struct<revision:string>>>"


def path_rows(documents: DataFrame) -> DataFrame:
    """Every path with its steps in its row, for what goes by path: a document is parsed once and nothing is shuffled.

    uri, graph_id, path_pos, path_id, head, base_uri, base_ref, title, ref_url, as paths() has them;
    steps: step_id, parents, actor, ts, files, intent, revision, as steps() has them, by pos, null for a
    reference; based: a path of the document has a base_ref.
    """
    title = "meta:struct<title:string>"
    alone = lambda kind: F.struct(_alone_names().alias("path"), F.array(_v("doc", "$.Step", DRAWN_STEP)).alias("steps"), F.lit(None).cast("struct<title:string>").alias("meta")).cast(kind)
    ref = lambda p: p["path"]["base"]["ref"].isNotNull()
    base = "struct<path:struct<base:struct<ref:string>>>"
    d = _parsed(documents).where("error is null")
    based = F.coalesce(F.exists(_v("doc", "$.Graph.paths", f"array<{base}>"), ref), ref(_v("doc", "$.Path", base)), F.lit(False))
    each = _each_path(d.withColumn("based", based), f"path:{PATH_NAMES},steps:array<{DRAWN_STEP}>,{title}", alone, "based")
    none = lambda kind: F.array().cast(kind)
    step = lambda s: F.struct(s["step"]["id"].alias("step_id"), F.coalesce(s["step"]["parents"], none("array<string>")).alias("parents"), s["step"]["actor"].alias("actor"), s["step"]["timestamp"].alias("ts"), F.coalesce(F.map_keys(s["change"]), none("array<string>")).alias("files"), s["meta"]["intent"].alias("intent"), s["meta"]["source"]["revision"].alias("revision"))
    p = F.col("__path")
    return each.select(
        "uri", "graph_id", "path_pos", p["path"]["id"].alias("path_id"), p["path"]["head"].alias("head"), p["path"]["base"]["uri"].alias("base_uri"), p["path"]["base"]["ref"].alias("base_ref"), p["meta"]["title"].alias("title"),
        "ref_url", F.when(F.col("ref_url").isNull(), F.transform(p["steps"], step)).alias("steps"), "based",
    )


def path_facts(documents: DataFrame) -> DataFrame:
    """uri, path_pos, path_id, title, n_steps and has_state (meta.track is there) of each inline path, in its document's row: parsed once, nothing is shuffled."""
    kind = "path:struct<id:string>,steps:array<boolean>,meta:struct<title:string,track:variant>"
    alone = lambda whole: F.struct(F.struct(F.concat(F.lit("path-"), "id").alias("id")).alias("path"), F.array(F.lit(True)).alias("steps"), F.lit(None).cast("struct<title:string,track:variant>").alias("meta")).cast(whole)
    p = F.col("__path")
    each = _each_path(_parsed(documents).where("error is null"), kind, alone).where("ref_url is null")
    return each.select("uri", "path_pos", p["path"]["id"].alias("path_id"), p["meta"]["title"].alias("title"), F.size(p["steps"]).cast("long").alias("n_steps"), p["meta"]["track"].isNotNull().alias("has_state"))


def _alone_names() -> Column:
    return F.struct(F.concat(F.lit("path-"), "id").alias("id"), F.col("id").alias("head"), F.lit(None).cast("struct<uri:string,ref:string>").alias("base"))


def _alone_whole(kind: str) -> Column:
    """The path of a step that stands alone, with the step's actors."""
    actors = _v("doc", "$.Step.meta.actors")
    meta = F.when(actors.isNotNull(), F.to_variant_object(F.map_from_arrays(F.array(F.lit("actors")), F.array(actors))))
    return F.struct(_alone_names().alias("path"), F.array(_v("doc", "$.Step", READ_STEP)).alias("steps"), meta.alias("meta")).cast(kind)


def paths(documents: DataFrame) -> DataFrame:
    """Every path of the readable documents, references to other documents too.

    uri, graph_id, path_pos, path_id, head, base_uri, base_ref, title, actors, ref_url, body.
    A step that stands alone becomes the path of its one step.
    """
    d = _parsed(documents).where("error is null")
    actors = F.when(_v("doc", "$.Step.meta.actors").isNotNull(), _object(_field("actors", F.to_json(_v("doc", "$.Step.meta.actors")))))
    alone = _object(_field("path", _object(_field("id", _json(F.concat(F.lit("path-"), "id"))), _field("head", _json("id")))), _field("steps", F.concat(F.lit("["), F.to_json(_v("doc", "$.Step")), F.lit("]"))), _field("meta", actors))
    bodies = F.when(F.col("kind") == "Graph", _v("doc", "$.Graph.paths", "array<variant>")).when(F.col("kind") == "Path", F.array(_v("doc", "$.Path"))).otherwise(F.array(F.parse_json(alone)))
    in_graph = F.col("kind") == "Graph"
    each = d.select("uri", F.when(in_graph, F.col("id")).alias("graph_id"), F.when(in_graph, _v("doc", "$.Graph.meta.actors")).alias("__graph_actors"), F.posexplode(bodies).alias("path_pos", "body"))
    return each.select(
        "uri", "graph_id", "path_pos", _v("body", "$.path.id", "string").alias("path_id"), _v("body", "$.path.head", "string").alias("head"), _v("body", "$.path.base.uri", "string").alias("base_uri"), _v("body", "$.path.base.ref", "string").alias("base_ref"), _v("body", "$.meta.title", "string").alias("title"),
        F.to_json(F.coalesce(_v("body", "$.meta.actors"), F.col("__graph_actors"))).alias("actors"), F.when(_is_ref(F.col("body")), _v("body", "$['$ref']", "string")).alias("ref_url"), "body",
    )


def steps(documents: DataFrame) -> DataFrame:
    """Every step of every path: uri, graph_id, path_pos, path_id, pos, step_id, parents, actor, ts, change, intent, revision, refs, meta (JSON text, whole).

    path_id is null for none; for operators that go by path, scoped() makes it
    unique over all documents.
    """
    d = _parsed(documents).where("error is null")
    kind = F.col("kind")
    of_graph = F.transform(_v("doc", "$.Graph.paths", f"array<struct<`$ref`:variant,path:struct<id:string>,steps:array<{READ_STEP}>>>"), lambda p: F.struct(p["path"]["id"].alias("path_id"), F.when(~_text(p["$ref"]), p["steps"]).alias("steps")))
    of_path = F.array(F.struct(_v("doc", "$.Path.path.id", "string").alias("path_id"), _v("doc", "$.Path.steps", f"array<{READ_STEP}>").alias("steps")))
    alone = F.array(F.struct(F.concat(F.lit("path-"), "id").alias("path_id"), F.array(_v("doc", "$.Step", READ_STEP)).alias("steps")))
    found = F.when(kind == "Graph", of_graph).when(kind == "Path", of_path).otherwise(alone)
    each = d.select("uri", F.when(kind == "Graph", F.col("id")).alias("graph_id"), F.posexplode(found).alias("path_pos", "__path"))
    each = each.select("uri", "graph_id", "path_pos", F.col("__path.path_id").alias("path_id"), F.posexplode("__path.steps").alias("pos", "s"))
    change = F.transform_values("s.change", lambda _, c: F.struct(c["raw"].alias("raw"), F.to_json(c["structural"]).alias("structural")))
    return each.select(
        "uri", "graph_id", "path_pos", "path_id", "pos", F.col("s.step.id").alias("step_id"), F.coalesce("s.step.parents", F.array().cast("array<string>")).alias("parents"), F.col("s.step.actor").alias("actor"), F.col("s.step.timestamp").alias("ts"), change.alias("change"),
        _v("s.meta", "$.intent", "string").alias("intent"), _v("s.meta", "$.source.revision", "string").alias("revision"), F.coalesce(_v("s.meta", "$.refs", REF), F.array().cast(REF)).alias("refs"), F.to_json("s.meta").alias("meta"),
    )


def scoped(rows: DataFrame) -> DataFrame:
    """Rows whose path_id is unique over documents: uri, place in it and id."""
    return rows.withColumn("path_id", F.concat_ws("#", "uri", F.col("path_pos").cast("string"), "path_id"))


def first_path_only(rows: DataFrame) -> DataFrame:
    """Rows of the first inline path of each document, as one-document tools have it."""
    first = rows.where("path_id is not null").groupBy("uri").agg(F.min("path_pos").alias("__first"))
    return rows.join(first, "uri").where("path_pos = __first").drop("__first")


def merge(documents: DataFrame, title: str | None = None) -> DataFrame:
    """One graph document of all paths: (graph_id, raw).

    Single steps are wrapped in a path; references stay; nothing is
    de-duplicated.  The one row is the output file; its size is that of all
    the inputs, so it is for documents that one process could hold.
    """
    d = parse(documents).where("error is null")
    body = F.to_json("body")
    wrapped = F.concat(F.lit('{"path":{"id":'), F.to_json(F.concat(F.lit("path-"), "id").cast("variant")), F.lit(',"head":'), F.to_json(F.col("id").cast("variant")), F.lit('},"steps":['), body, F.lit("]}"))
    single = d.where("kind <> 'Graph'").select("uri", F.lit(0).alias("pos"), F.when(F.col("kind") == "Step", wrapped).otherwise(body).alias("p"))
    inner = d.where("kind = 'Graph'").select("uri", F.posexplode(_v("body", "$.paths", "array<variant>")).alias("pos", "x")).select("uri", "pos", F.to_json("x").alias("p"))
    parts = single.unionAll(inner).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uri", "pos", "p"))), lambda s: s["p"]), ",").alias("all"))
    graph_id = F.concat(F.lit("graph-merged-"), F.col("n").cast("string"))
    meta = F.concat(F.lit(',"meta":{"title":'), F.to_json(F.lit(title).cast("variant")), F.lit("}")) if title is not None else F.lit("")
    return parts.select(graph_id.alias("graph_id"), F.concat(F.lit('{"Graph":{"graph":{"id":'), F.to_json(graph_id.cast("variant")), F.lit('},"paths":['), "all", F.lit("]"), meta, F.lit("}}")).alias("raw"))


#: Strict rules (fixed values).
ACTOR_RULE = r"^(human|agent|tool|ci):[a-zA-Z0-9_-]+(/[a-zA-Z0-9_.-]+)?$"
KEY_TYPES = ("gpg", "ssh", "sigstore")
SCOPES = ("author", "reviewer", "witness", "ci", "release")


#: What the strict rules look at of a step, by one cast.
STRICT_STEP = "struct<step:struct<id:string,parents:array<string>,actor:string,timestamp:string>,change:map<string,struct<raw:string,structural:variant>>>"


def strict_findings(documents: DataFrame) -> DataFrame:
    """(uri, path_id, step_id, finding): what the strict format forbids and parse() lets pass.

    All rules are about one path, so each is looked at in its document's row:
    parsed once, nothing is shuffled or stored.  Only the steps of paths that
    have an unknown parent are searched for it.
    """
    from provmill.operators.dag import marks

    kind = f"path:struct<id:string,head:string,base:map<string,variant>>,steps:array<{STRICT_STEP}>"
    names = F.struct(F.concat(F.lit("path-"), "id").alias("id"), F.col("id").alias("head"), F.lit(None).cast("map<string,variant>").alias("base"))
    alone = lambda whole: F.struct(names.alias("path"), F.array(_v("doc", "$.Step", STRICT_STEP)).alias("steps")).cast(whole)
    p = F.col("__path")
    none, texts = F.lit(None).cast("string"), lambda c: F.coalesce(c, F.array().cast("array<string>"))
    inline = scoped(_each_path(_parsed(documents).where("error is null"), kind, alone).where("ref_url is null").withColumn("path_id", p["path"]["id"])).select("uri", "path_id", p["path"]["head"].alias("head"), p["path"]["base"].alias("base"), p["steps"].alias("steps"))
    each = once(inline, F.transform("steps", lambda s: s["step"]["id"]).alias("ids"), F.transform("steps", lambda s: texts(s["step"]["parents"])).alias("parents"))
    unknown = F.size(F.array_except(F.flatten("parents"), "ids")) > 0
    marked = each.withColumn("marks", marks(F.when(unknown, F.col("head")), F.when(unknown, F.col("ids")), F.when(unknown, F.col("parents"))))
    found = lambda step, finding: F.struct(step.alias("step_id"), finding.alias("finding"))
    one = lambda bad, step, finding: F.when(F.coalesce(bad, F.lit(False)), F.array(found(step, F.lit(finding)))).otherwise(F.array().cast("array<struct<step_id:string,finding:string>>"))
    of_steps = lambda bad, finding: F.transform(F.filter("steps", bad), lambda s: found(s["step"]["id"], F.lit(finding)))
    in_order = F.array_sort("ids")
    again = F.array_distinct(F.filter(in_order, lambda x, i: (i > 0) & (x == F.get(in_order, i - 1))))
    lost = F.flatten(F.transform("marks", lambda m, i: F.transform(F.filter(m, lambda x, j: (j > 0) & (x == 0)), lambda _: found(F.get("ids", i), F.lit("parent is no step")))))
    keys = F.filter(F.map_keys("base"), lambda k: ~k.isin("uri", "ref"))
    empty = F.array().cast("array<struct<step_id:string,finding:string>>")
    all_ = F.concat(*(F.coalesce(c, empty) for c in (
        one(F.try_variant_get(F.element_at("base", "uri"), "$", "string").isNull(), none, "path without base"),
        of_steps(lambda s: ~s["step"]["actor"].rlike(ACTOR_RULE), "actor"),
        of_steps(lambda s: F.try_to_timestamp(s["step"]["timestamp"]).isNull(), "timestamp"),
        of_steps(lambda s: F.exists(F.map_values(s["change"]), lambda c: c["raw"].isNull() & (c["structural"].isNull() | F.is_variant_null(c["structural"]))), "change without raw or structural"),
        F.transform(again, lambda x: found(x, F.lit("step id not unique"))),
        one(~F.array_contains("ids", F.col("head")), F.col("head"), "head is no step"),
        lost,
        F.transform(keys, lambda k: found(none, F.concat(F.lit("base key "), k))),
    )))
    return marked.select("uri", "path_id", F.inline(all_))


def signatures(documents: DataFrame) -> DataFrame:
    """(uri, path_id, signer, key, scope, sig, defined): signatures of paths; defined: the signer is among the actors and has the key."""
    p = scoped(paths(documents)).where("ref_url is null")
    s = p.select("uri", "path_id", F.from_json("actors", f"map<string,{ACTOR}>").alias("a"), F.explode(_v("body", "$.meta.signatures", SIGNATURE)).alias("x"))
    keys = F.coalesce(F.element_at("a", F.col("x.signer"))["keys"], F.array().cast("array<struct<type:string,fingerprint:string,href:string>>"))
    return s.select("uri", "path_id", "x.signer", "x.key", "x.scope", "x.sig", F.exists(keys, lambda k: k["fingerprint"] == F.col("x.key")).alias("defined"))


def missing_scopes(documents: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(uri, path_id, missing): required signature scopes that a path lacks."""
    have = signatures(documents).groupBy("path_id").agg(F.collect_set("scope").alias("have"))
    p = scoped(paths(documents)).where("ref_url is null").select("uri", "path_id").join(have, "path_id", "left")
    lack = F.array_except(F.array(*map(F.lit, required)), F.coalesce("have", F.array().cast("array<string>")))
    return p.select("uri", "path_id", lack.alias("missing")).where(F.size("missing") > 0)


def _json(c: Column | str) -> Column:
    """A string as JSON."""
    return F.to_json((F.col(c) if isinstance(c, str) else c).cast("variant"))


def _field(name: str, value: Column) -> Column:
    """A field of an object; null where the value is."""
    return F.concat(F.lit(f'"{name}":'), value)


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _meta(columns: list[str]) -> Column:
    """A step's meta as it was read, else of the columns that derived steps have; null if there is nothing in it."""
    if "meta" in columns:
        return F.col("meta")
    source = F.when(F.col("revision").isNotNull(), _object(_field("type", F.lit('"git"')), _field("revision", _json("revision"))))
    refs = F.when(F.size("refs") > 0, F.to_json("refs")) if "refs" in columns else F.lit(None).cast("string")
    return F.when(F.coalesce(F.col("intent"), F.col("revision"), refs).isNotNull(), _object(_field("intent", _json("intent")), _field("source", source), _field("refs", refs)))


def step_json(rows: DataFrame) -> Column:
    """One step as JSON: what was read, but for unknown keys outside meta; nulls and empty parents are left out."""
    identity = _object(_field("id", _json("step_id")), _field("parents", F.when(F.size("parents") > 0, F.to_json("parents"))), _field("actor", _json("actor")), _field("timestamp", _json("ts")))
    one = lambda e: F.concat(_json(e["key"]), F.lit(":"), _object(_field("raw", _json(e["value"]["raw"])), _field("structural", e["value"]["structural"])))
    change = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys("change")), lambda k: one(F.struct(k.alias("key"), F.element_at("change", k).alias("value")))), ","), F.lit("}"))
    return _object(_field("step", identity), _field("change", F.coalesce(change, F.lit("{}"))), _field("meta", _meta(rows.columns)))


def rewritten(documents: DataFrame) -> DataFrame:
    """(uri, path_pos, path_id, raw): each inline path of the readable documents written as a Path document, as path_documents() has it.

    A document's steps stay in its row: nothing is shuffled, and one call writes the whole text.
    """
    p = _each_path(_parsed(documents).where("error is null"), f"path:{PATH_NAMES},steps:array<{READ_STEP}>,meta:variant", _alone_whole).where("ref_url is null").select("uri", "path_pos", "__path.*")
    # fields that are null are left out
    base = F.when(F.col("path.base.uri").isNotNull(), F.col("path.base"))
    one = lambda v: F.struct(v["raw"].alias("raw"), v["structural"].alias("structural"))
    in_order = lambda c, keys: F.map_from_arrays(keys, F.transform(keys, lambda k: one(F.element_at(c, k))))
    change = lambda c: F.when(F.size(c) <= 1, F.transform_values(c, lambda _, v: one(v))).otherwise(in_order(c, F.array_sort(F.map_keys(c))))
    step = lambda s: F.struct(F.struct(s["step"]["id"].alias("id"), F.when(F.size(s["step"]["parents"]) > 0, s["step"]["parents"]).alias("parents"), s["step"]["actor"].alias("actor"), s["step"]["timestamp"].alias("timestamp")).alias("step"), change(s["change"]).alias("change"), s["meta"].alias("meta"))
    path = F.struct(F.struct(F.col("path.id").alias("id"), base.alias("base"), F.col("path.head").alias("head")).alias("path"), F.transform("steps", step).alias("steps"), F.col("meta").alias("meta"))
    return p.select("uri", "path_pos", F.col("path.id").alias("path_id"), F.to_json(F.struct(path.alias("Path")), {"ignoreNullFields": "true"}).alias("raw"))


def _step_arrays(rows: DataFrame) -> DataFrame:
    """(path_id, steps): the steps of each path as a JSON array in order."""
    each = rows.select("path_id", "pos", step_json(rows).alias("j"))
    return each.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda x: x["j"]).alias("all")).select("path_id", F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")).alias("steps"))


def to_json(rows: DataFrame) -> DataFrame:
    """(path_id, raw): the steps of each path as a JSON array in order; artifacts by name, nulls and empty parts left out."""
    return _step_arrays(rows).select("path_id", F.col("steps").alias("raw"))


def path_documents(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """(path_id, raw): a Path document for each inline path.

    ``paths``: path_id, head, base_uri, base_ref, title, and id, the name that
    the document gets (path_id without it); paths without steps have none.
    """
    name = _json("id" if "id" in paths.columns else "path_id")
    base = F.when(F.col("base_uri").isNotNull(), _object(_field("uri", _json("base_uri")), _field("ref", _json("base_ref"))))
    meta = F.to_json(F.try_variant_get("body", "$.meta", "variant")) if "body" in paths.columns else F.when(F.col("title").isNotNull(), _object(_field("title", _json("title"))))
    whole = paths.join(_step_arrays(rows), "path_id", "left")
    inner = _object(_field("path", _object(_field("id", name), _field("base", base), _field("head", _json("head")))), _field("steps", F.coalesce("steps", F.lit("[]"))), _field("meta", meta))
    return whole.select("path_id", F.concat(F.lit('{"Path":'), inner, F.lit("}")).alias("raw"))


def document_lines(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """(path_id, section, ord, line): path_documents() in lines, one a step, for sources.line_files."""
    name = _json("id" if "id" in paths.columns else "path_id")
    base = F.when(F.col("base_uri").isNotNull(), _object(_field("uri", _json("base_uri")), _field("ref", _json("base_ref"))))
    meta = F.to_json(F.try_variant_get("body", "$.meta", "variant")) if "body" in paths.columns else F.when(F.col("title").isNotNull(), _object(_field("title", _json("title"))))
    head = F.concat(F.lit('{"Path":{"path":'), _object(_field("id", name), _field("base", base), _field("head", _json("head"))), F.lit(',"steps":['))
    row = lambda section, ord, line: (F.lit(section).alias("section"), ord.cast("long").alias("ord"), line.alias("line"))
    ends = paths.select("path_id", F.inline(F.array(F.struct(*row(0, F.lit(0), head)), F.struct(*row(2, F.lit(0), F.concat(F.lit("]"), F.coalesce(F.concat(F.lit(","), _field("meta", meta)), F.lit("")), F.lit("}}")))))))
    first = rows.groupBy("path_id").agg(F.min("pos").alias("__first"))
    of_paths = rows.join(first, "path_id").join(paths.select("path_id"), "path_id", "left_semi")
    return ends.unionByName(of_paths.select("path_id", *row(1, F.col("pos"), F.concat(F.when(F.col("pos") > F.col("__first"), ",").otherwise(""), step_json(rows)))))


def merged_lines(documents: DataFrame, title: str | None = None) -> DataFrame:
    """(graph_id, section, uri, pos, line): merge() in lines, one a path, for sources.line_files.

    The lines lie in the order of the file (section, uri, pos), partition after
    partition, dealt by ranges of the uri; no task has them all.
    """
    n_paths = F.when(F.col("kind") == "Graph", F.size(_v("doc", "$.Graph.paths", "array<boolean>"))).otherwise(1)
    counted = _parsed(documents).where("error is null").select("uri", n_paths.alias("n")).where("n > 0")
    n, first = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("uri")).first()
    graph_id = f"graph-merged-{n}"
    d = parse(documents.select("uri", "raw").repartitionByRange("uri")).where("error is null").select("uri", "kind", "id", "body")
    text = F.to_json("body")
    wrapped = F.concat(F.lit('{"path":{"id":'), F.to_json(F.concat(F.lit("path-"), "id").cast("variant")), F.lit(',"head":'), F.to_json(F.col("id").cast("variant")), F.lit('},"steps":['), text, F.lit("]}"))
    all_ = F.when(F.col("kind") == "Graph", F.transform(_v("body", "$.paths", "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(F.when(F.col("kind") == "Step", wrapped).otherwise(text)))
    each = d.select("uri", F.posexplode(all_).alias("pos", "line"))
    k = F.row_number().over(Window.partitionBy("uri").orderBy("pos"))
    lead = F.when(F.col("uri").eqNullSafe(F.lit(first)) & (F.col("__k") == 1), "").otherwise(",")
    inside = each.withColumn("__k", k).sortWithinPartitions("uri", "pos").select(F.lit(graph_id).alias("graph_id"), F.lit(1).alias("section"), "uri", "pos", F.concat(lead, "line").alias("line"))
    meta = F.concat(F.lit(',"meta":{"title":'), F.to_json(F.lit(title).cast("variant")), F.lit("}")) if title is not None else F.lit("")
    end = lambda section, text: documents.sparkSession.range(1).select(F.lit(graph_id).alias("graph_id"), F.lit(section).alias("section"), F.lit("").alias("uri"), F.lit(0).alias("pos"), text.alias("line"))
    return end(0, F.lit('{"Graph":{"graph":{"id":"' + graph_id + '"},"paths":[')).unionByName(inside).unionByName(end(2, F.concat(F.lit("]"), meta, F.lit("}}"))))


def pretty(raw: str) -> str:
    """One collected document, indented."""
    import json

    return json.dumps(json.loads(raw), indent=2, ensure_ascii=False)


# builders: rows with step_id, actor and ts become steps


def new_steps(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    change = F.create_map().cast("map<string,struct<raw:string,structural:string>>")
    return rows.withColumns({"parents": F.array().cast("array<string>"), "change": change, "intent": none, "revision": none, "refs": F.array().cast(REF)})


def with_parent(rows: DataFrame, parent: Column) -> DataFrame:
    return rows.withColumn("parents", F.concat("parents", F.array(parent)))


def with_raw_change(rows: DataFrame, artifact: Column, raw: Column) -> DataFrame:
    """A change of an artifact that has one takes its place."""
    new = F.create_map(artifact, F.struct(raw.alias("raw"), F.lit(None).cast("string").alias("structural")))
    return rows.withColumn("change", F.map_concat(F.map_filter("change", lambda k, _: k != artifact), new))


def with_intent(rows: DataFrame, intent: Column) -> DataFrame:
    return rows.withColumn("intent", intent)


def with_revision(rows: DataFrame, revision: Column) -> DataFrame:
    return rows.withColumn("revision", revision)


def first_match(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each id asked for (uri, step_id) the first step of the document that has it."""
    key = ["uri", "step_id"]
    rest = [c for c in rows.columns if c not in key]
    found = rows.join(ids.select(*key).distinct(), key, "left_semi")
    return found.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("path_pos", "pos")).alias("__first")).select(*key, "__first.*")


def head_of_step(rows: DataFrame, all_paths: DataFrame, ids: DataFrame) -> DataFrame:
    """(uri, step_id, head): the head of the first path that has the step."""
    return first_match(rows, ids).select("uri", "step_id", "path_pos").join(all_paths.select("uri", "path_pos", "head"), ["uri", "path_pos"]).select("uri", "step_id", "head")


def find_steps(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each id asked for (uri, step_id) the first step of the document that has it, and the head of its path: uri, step_id, path_pos, head, parents, actor, ts, intent, revision.

    first_match() and head_of_step() by document, for a few ids of each: a document
    meets its ids once, so what is dealt by uri already is not dealt again.
    """
    asked = ids.select("uri", "step_id").where("step_id is not null").groupBy("uri").agg(F.collect_set("step_id").alias("__asked"))
    return searched(path_rows(documents).join(asked, "uri"), "__asked")


def searched(rows: DataFrame, asked: str) -> DataFrame:
    """find_steps() in path_rows() that have the ids asked for (an array, column ``asked``) beside them."""
    found = F.filter(F.transform("steps", lambda s, i: F.struct(i.alias("pos"), s.alias("s"))), lambda x: F.array_contains(asked, x["s"]["step_id"]))
    each = rows.select("uri", "path_pos", "head", F.explode(found).alias("x"))
    first = each.groupBy("uri", F.col("x.s.step_id").alias("step_id")).agg(F.min_by(F.struct("path_pos", "head", "x.s"), F.struct("path_pos", "x.pos")).alias("__first"))
    field = lambda n: F.col(f"__first.s.{n}").alias(n)
    return first.select("uri", "step_id", "__first.path_pos", "__first.head", *map(field, ("parents", "actor", "ts", "intent", "revision")))
