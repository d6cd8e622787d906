"""Graph drawings (DOT) and layouts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provmill.functions import text as X
from provmill.operators import dag
from provmill.operators import steps as S
from provmill.sources import documents as D

#: Colours of dead ends and of clusters in turn, and attributes of nodes and edges (fixed values of the format).
DEAD_COLOUR = "#ffcccc"
FILLS = ("#e3f2fd", "#e8f5e9", "#fff3e0", "#f3e5f5", "#e0f7fa", "#fce4ec")
NODE = '  node [shape=box, style=rounded, fontname="Helvetica"];'
ON, OFF = 'color="#333333", penwidth=2', 'color="#cccccc", style=dashed'
REF = 'shape=note, style=filled, fillcolor="#ffffcc"'
GRAPH_FRAME = ("digraph provenance {", "  rankdir=TB;", "  compound=true;", "  newrank=true;", NODE, '  edge [color="#333333"];', "  splines=ortho;", "")


def cluster_number(pos: Column | str) -> Column:
    """Which of the colours the cluster at a place of its graph has."""
    return F.pmod(F.col(pos) if isinstance(pos, str) else pos, F.lit(len(FILLS)))


def cluster_fill(pos: Column | str) -> Column:
    """The colour of the cluster at a place of its graph."""
    return F.element_at(F.array(*map(F.lit, FILLS)), cluster_number(pos).cast("int") + 1)


def step_lines(steps: DataFrame, timestamps: bool = False, files: bool = True) -> DataFrame:
    """(path_id, step_id, section, ord, line) of the drawing of each step alone: its node and what leads to it."""
    key = ["path_id", "step_id"]
    fixed = lambda section, *text: steps.select(*key, F.lit(section).alias("section"), F.posexplode(F.array(*map(F.lit, text))).alias("ord", "line"))
    node = F.concat(F.lit("  "), quoted("step_id"), F.lit(" [label="), label(steps, timestamps, files), F.lit(', fillcolor="'), X.actor_color("actor"), F.lit('", style="rounded,filled"];'))
    nodes = steps.select(*key, F.lit(1).alias("section"), F.lit(0).alias("ord"), node.alias("line"))
    links = steps.select(*key, F.lit(2).alias("section"), F.posexplode("parents").alias("ord", "__p")).select(*key, "section", "ord", F.concat(F.lit("  "), quoted("__p"), F.lit(" -> "), quoted("step_id"), F.lit(";")).alias("line"))
    return fixed(0, "digraph provenance {", "  rankdir=TB;", NODE, "").unionByName(nodes).unionByName(links).unionByName(fixed(3, "}"))


def label(steps: DataFrame, timestamps: bool = False, files: bool = True) -> Column:
    """A step's label: revision or id, actor, intent, and on request time and files."""
    font = lambda size, body, extra="": F.concat(F.lit(f'<font point-size="{size}"{extra}>'), body, F.lit("</font>"))
    head = F.coalesce(X.prefix("revision", 8), F.col("step_id"))
    rows = [F.concat(F.lit("<b>"), X.escape_html(head), F.lit("</b>")), font(10, X.escape_html(X.actor_label("actor"))), font(9, F.concat(F.lit("<i>"), X.escape_html(X.intent_label("intent")), F.lit("</i>")))]
    if timestamps:
        rows.append(font(8, X.escape_html(X.time_of_day("ts")), ' color="gray"'))
    if files:
        names = F.array_sort("files" if "files" in steps.columns else F.map_keys("change"))
        few = F.array_join(F.transform(names, lambda f: F.substring_index(f, "/", -1)), ", ")
        what = F.when(F.size(names) == 0, F.lit(None)).when(F.size(names) <= 2, few).otherwise(F.concat(F.size(names).cast("string"), F.lit(" files")))
        rows.append(font(8, X.escape_html(what), ' color="#666666"'))
    return F.concat(F.lit("<"), F.concat_ws("<br/>", *rows), F.lit(">"))


def quoted(s: Column | str) -> Column:
    return F.concat(F.lit('"'), X.escape_dot(s), F.lit('"'))


def path_lines(paths: DataFrame, steps: DataFrame, timestamps: bool = False, files: bool = True, dead: bool = True) -> DataFrame:
    """(path_id, section, ord, line) of the drawing of each path.

    ``paths``: path_id, head, base_uri, base_ref, title; ``steps``: what
    sources.documents.steps() has.
    """
    on = dag.ancestor_ids(steps, paths.select("path_id", "head")).withColumn("active", F.lit(True))
    known = steps.join(on, ["path_id", "step_id"], "left").join(paths.select("path_id", "head", "base_uri"), "path_id")
    fixed = lambda section, *text: paths.select("path_id", F.lit(section).alias("section"), F.posexplode(F.array(*map(F.lit, text))).alias("ord", "line"))
    out = [fixed(0, "digraph provenance {", "  rankdir=TB;", NODE, '  edge [color="#666666"];', "  splines=ortho;", "")]
    title = paths.where("title is not null").select("path_id", F.lit(1).alias("section"), F.posexplode(F.array(F.lit('  labelloc="t";'), F.concat(F.lit("  label="), quoted("title"), F.lit(";")), F.lit("  fontsize=16;"), F.lit('  fontname="Helvetica-Bold";'), F.lit(""))).alias("ord", "line"))
    small = X.prefix(F.coalesce("base_ref", F.lit("")), 8)
    base_label = F.concat(F.lit('<<b>BASE</b><br/><font point-size="10">'), X.escape_html("base_uri"), F.lit('</font><br/><font point-size="9" color="#666666">'), X.escape_html(small), F.lit("</font>>"))
    base = paths.where("base_uri is not null").select("path_id", F.lit(2).alias("section"), F.lit(0).alias("ord"), F.concat(F.lit('  "__base__" [label='), base_label, F.lit(', shape=ellipse, style=filled, fillcolor="#e0e0e0"];')).alias("line"))
    is_head = F.col("step_id") == F.col("head")
    is_dead = F.col("active").isNull() & F.lit(dead)
    style = F.when(is_head, "rounded,filled,bold").when(is_dead, "rounded,filled,dashed").otherwise("rounded,filled")
    colour = F.when(~is_head & is_dead, DEAD_COLOUR).otherwise(X.actor_color("actor"))
    node = F.concat(F.lit("  "), quoted("step_id"), F.lit(" [label="), label(steps, timestamps, files), F.lit(', fillcolor="'), colour, F.lit('", style="'), style, F.lit('", penwidth='), F.when(is_head, "3").otherwise("1"), F.lit("];"))
    nodes = known.select("path_id", F.lit(3).alias("section"), F.col("pos").alias("ord"), node.alias("line"))
    child_pos = steps.select("path_id", F.col("step_id").alias("child"), "pos")
    link = F.concat(F.lit("  "), quoted("parent"), F.lit(" -> "), quoted("child"), F.lit(" ["), F.when(F.col("active"), ON).otherwise(OFF), F.lit("];"))
    links = dag.active_edges(steps, paths.select("path_id", "head")).join(child_pos, ["path_id", "child"]).select("path_id", F.lit(5).alias("section"), (F.col("pos") * 1000 + F.col("ord")).alias("ord"), link.alias("line"))
    roots = known.where("size(parents) = 0 and base_uri is not null").select("path_id", F.lit(5).alias("section"), (F.col("pos") * 1000).alias("ord"), F.concat(F.lit('  "__base__" -> '), quoted("step_id"), F.lit(";")).alias("line"))
    legend = ["", "  // Legend", "  subgraph cluster_legend {", '    label="Legend";', '    fontname="Helvetica-Bold";', "    style=filled;", '    fillcolor="#f8f8f8";', '    node [shape=box, style="rounded,filled", width=0.9, fontname="Helvetica", fontsize=10];']
    legend += [f'    leg_{k} [label="{k}", fillcolor="{X.ACTOR_COLOURS[k]}"];' for k in ("human", "agent", "tool")]
    legend += [f'    leg_dead [label="dead end", fillcolor="{DEAD_COLOUR}", style="rounded,filled,dashed"];'] * dead
    legend += ["    leg_human -> leg_agent -> leg_tool [style=invis];", *["    leg_tool -> leg_dead [style=invis];"] * dead, "  }", "}"]
    for part in (title, base, nodes, fixed(4, ""), links, roots, fixed(6, *legend)):
        out.append(part)
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def joined(lines: DataFrame, key: str = "path_id") -> DataFrame:
    """(key, dot): the lines of each drawing put together, as it is one file."""
    row = F.struct("section", "ord", "line")
    return lines.groupBy(key).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n"), F.lit("\n")).alias("dot"))


def cluster_lines(paths: DataFrame) -> DataFrame:
    """(graph_id, section, ord, line) of what opens the cluster of each inline path; ``paths`` as for graph_lines(), steps aren't needed."""
    opened = F.array(F.concat(F.lit("  subgraph cluster_"), F.col("path_pos").cast("string"), F.lit(" {")), F.concat(F.lit("    label="), quoted(F.coalesce("title", "path_id")), F.lit(";")), F.lit('    fontname="Helvetica-Bold";'), F.lit("    style=filled;"), F.concat(F.lit('    fillcolor="'), cluster_fill("path_pos"), F.lit('";')), F.lit("    margin=12;"), F.lit(""))
    return paths.where("ref_url is null").select("graph_id", (F.col("path_pos") * 10 + 10).cast("long").alias("section"), F.posexplode(opened).alias("ord", "line"))


def _node_id(path: Column, step: Column) -> Column:
    return quoted(F.concat(path, F.lit("/"), step))


def _node_line(steps: DataFrame, is_dead: Column, timestamps: bool, files: bool) -> Column:
    """A step's node in its cluster."""
    is_head = F.col("step_id") == F.col("head")
    colour = F.when(~is_head & is_dead, DEAD_COLOUR).otherwise(X.actor_color("actor"))
    style = F.when(is_head, "rounded,filled,bold").when(is_dead, "rounded,filled,dashed").otherwise("rounded,filled")
    return F.concat(F.lit("    "), _node_id(F.col("path_id"), F.col("step_id")), F.lit(" [label="), label(steps, timestamps, files), F.lit(', fillcolor="'), colour, F.lit('", style="'), style, F.lit('", penwidth='), F.when(is_head, "3").otherwise("1"), F.lit("];"))


def _ref_line() -> Column:
    """The node of a reference to another document."""
    return F.concat(F.lit('  "ref_'), F.col("path_pos").cast("string"), F.lit('" [label=<<b>$ref</b><br/><font point-size="9">'), X.escape_html("ref_url"), F.lit(f"</font>>, {REF}];"))


def _cross_lines(inline: DataFrame, steps: DataFrame) -> DataFrame:
    """(graph_id, section, ord, line) of the edges from bases that are steps of other paths to the roots of what is based on them; both have name, the path's in node ids."""
    based = S.base_steps(inline.where("base_ref is not null").select("graph_id", "path_id", "base_ref"), steps.where("revision is not null")).where("base_step is not null")
    origin = steps.where("revision is not null").groupBy("graph_id", F.col("step_id").alias("base_step")).agg(F.max_by(F.struct("path_id", "name"), F.struct("path_pos", "pos")).alias("from"))
    roots = dag.roots(steps).select("path_id", "name", "step_id", "pos")
    line = F.concat(F.lit("  "), _node_id(F.col("from.name"), F.col("base_step")), F.lit(" -> "), _node_id(F.col("name"), F.col("step_id")), F.lit(f" [{ON}];"))
    return based.join(origin, ["graph_id", "base_step"]).join(roots, "path_id").where("from.path_id <> path_id").select("graph_id", F.lit(1_000_000_001).cast("long").alias("section"), F.col("pos").alias("ord"), line.alias("line"))


def graph_lines(paths: DataFrame, steps: DataFrame, timestamps: bool = False, files: bool = True, dead: bool = True) -> DataFrame:
    """(graph_id, section, ord, line) of the drawing of each graph: a cluster for each path.

    ``paths`` also have graph_id, path_pos and ref_url, ``steps`` graph_id,
    path_pos and revision.  Node ids carry their path, so equal step ids don't
    collide.
    """
    inline = paths.where("ref_url is null")
    graphs = paths.select("graph_id").distinct()
    fixed = lambda section, *text: graphs.select("graph_id", F.lit(section).cast("long").alias("section"), F.posexplode(F.array(*map(F.lit, text))).alias("ord", "line"))
    node_id = _node_id
    on = dag.ancestor_ids(steps, inline.select("path_id", "head")).withColumn("active", F.lit(True))
    known = steps.join(on, ["path_id", "step_id"], "left").join(inline.select("path_id", "head", "title", "path_pos").withColumnRenamed("path_pos", "__p"), "path_id")
    at = lambda offset: (F.col("path_pos") * 10 + offset + 10).cast("long").alias("section")
    clusters = cluster_lines(paths)
    ends = inline.select("graph_id", at(2), F.lit(0).alias("ord"), F.lit("  }").alias("line"))
    is_dead = F.col("active").isNull() & F.lit(dead)
    nodes = known.select("graph_id", at(1), F.col("pos").alias("ord"), _node_line(steps, is_dead, timestamps, files).alias("line"))
    late = lambda: F.lit(1_000_000_000).cast("long").alias("section")
    links = dag.active_edges(steps, inline.select("path_id", "head")).join(steps.select("path_id", F.col("step_id").alias("parent")).distinct(), ["path_id", "parent"], "left_semi").join(steps.select("path_id", "graph_id", F.col("step_id").alias("child"), "pos"), ["path_id", "child"])
    links = links.select("graph_id", late(), (F.col("pos") * 1000 + F.col("ord")).alias("ord"), F.concat(F.lit("  "), node_id(F.col("path_id"), F.col("parent")), F.lit(" -> "), node_id(F.col("path_id"), F.col("child")), F.lit(" ["), F.when(F.col("active"), ON).otherwise(OFF), F.lit("];")).alias("line"))
    cross = _cross_lines(inline.withColumn("name", F.col("path_id")), steps.withColumn("name", F.col("path_id")))
    refs = paths.where("ref_url is not null").select("graph_id", at(0), F.lit(0).alias("ord"), _ref_line().alias("line"))
    out = fixed(0, *GRAPH_FRAME)
    for part in (clusters, nodes, ends, links, cross, refs, fixed(2_000_000_000, "}")):
        out = out.unionByName(part)
    return out


def graph_row_lines(rows: DataFrame, timestamps: bool = False, files: bool = True, dead: bool = True) -> DataFrame:
    """graph_lines() of paths that have their steps in their row (sources.documents.path_rows(), and the graph_id to draw by): a path is searched and drawn in its row, so steps are shuffled only in graphs that have a base.

    ``rows`` are read several times, some columns each time: dag.stored().
    """
    inline = rows.where("ref_url is null")
    at = lambda offset: (F.col("path_pos").cast("long") * 10 + offset + 10).alias("section")
    start = rows.where("path_pos = 0")
    fixed = lambda section, *text: start.select("graph_id", F.lit(section).cast("long").alias("section"), F.posexplode(F.array(*map(F.lit, text))).alias("ord", "line"))
    ends = inline.select("graph_id", at(2), F.lit(0).alias("ord"), F.lit("  }").alias("line"))
    refs = rows.where("ref_url is not null").select("graph_id", at(0), F.lit(0).alias("ord"), _ref_line().alias("line"))
    marked = inline.select("graph_id", "path_pos", "path_id", "head", F.posexplode(F.arrays_zip("steps", dag.marks(F.col("head"), F.col("steps.step_id"), F.col("steps.parents")).alias("marks"))).alias("pos", "__s"))
    each = marked.select("graph_id", "path_pos", "path_id", "head", F.col("pos").cast("long").alias("pos"), "__s.steps.*", F.col("__s.marks").alias("marks")).withColumn("active", F.get("marks", 0) == 1)
    node = F.struct(at(1), F.col("pos").alias("ord"), _node_line(each, ~F.col("active") & F.lit(dead), timestamps, files).alias("line"))
    link = lambda p, i: F.when(F.get("marks", i + 1) > 0, F.struct(F.lit(1_000_000_000).cast("long").alias("section"), (F.col("pos") * 1000 + i).alias("ord"), F.concat(F.lit("  "), _node_id(F.col("path_id"), p), F.lit(" -> "), _node_id(F.col("path_id"), F.col("step_id")), F.lit(" ["), F.when(F.col("active") & (F.get("marks", i + 1) == 2), ON).otherwise(OFF), F.lit("];")).alias("line")))
    drawn = each.select("graph_id", F.inline(F.concat(F.array(node), F.array_compact(F.transform("parents", link)))))
    key = F.concat_ws("#", "graph_id", F.col("path_pos").cast("string"))
    based = inline.where("based").select("graph_id", "path_pos", key.alias("path_id"), F.col("path_id").alias("name"), "base_ref", "steps")
    cross = _cross_lines(based, based.select("graph_id", "path_pos", "path_id", "name", F.posexplode("steps").alias("pos", "__s")).select("graph_id", "path_pos", "path_id", "name", "pos", "__s.step_id", "__s.parents", "__s.revision"))
    out = fixed(0, *GRAPH_FRAME)
    for part in (cluster_lines(rows), drawn, ends, cross, refs, fixed(2_000_000_000, "}")):
        out = out.unionByName(part)
    return out


def layout(paths: DataFrame, steps: DataFrame, timestamps: bool = False, files: bool = False, dead: bool = True, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What a viewer draws: (nodes, edges).

    Nodes: cluster, path_id, node_id, step_id, kind (base, ref, head, dead,
    step), label.  Edges: path_id, source, target, kind (base, on, off).

    Paths of one ``scope`` (a column of both, else the path itself) are drawn
    together: where there are several, each is a cluster and its node ids carry
    the path's place.  A path without a head has no dead ends.  ``dead``: dead
    ends are shown, with their edges.  Edges to what isn't drawn are left out; a
    path's base leads to the steps without parents.  A label has, line by line,
    the step, its actor (by name where steps.resolve_actors() has been there),
    its intent (30 characters), on request its time of day and its files (28
    characters each).
    """
    key = scope or "path_id"
    place = F.col("path_pos") if scope else F.lit(0)
    count = paths.groupBy(F.col(key).alias("__scope")).agg(F.count("*").alias("__n"))
    column = lambda c: F.col(c) if c in paths.columns else F.lit(None).cast("string")
    clusters = paths.select(F.col(key).alias("__scope"), place.alias("__place"), "path_id", "head", column("base_uri").alias("base_uri"), column("ref_url").alias("ref_url")).join(count, "__scope")
    several = F.col("__n") > 1
    clusters = clusters.withColumns({"cluster": F.when(several, F.concat(F.lit("cluster_"), F.col("__place").cast("string"))), "__prefix": F.when(several, F.concat(F.lit("c"), F.col("__place").cast("string"), F.lit("/"))).otherwise("")})
    clusters = dag.cut(clusters)
    none = F.lit(None).cast("string")
    bases = clusters.where("base_uri is not null").select("cluster", "path_id", F.concat("__prefix", F.lit("__BASE__")).alias("node_id"), none.alias("step_id"), F.lit("base").alias("kind"), F.lit("BASE").alias("label"))
    refs = clusters.where("ref_url is not null").select("cluster", "path_id", F.concat("__prefix", "ref_url").alias("node_id"), none.alias("step_id"), F.lit("ref").alias("kind"), F.concat(F.lit("$ref: "), "ref_url").alias("label"))
    marked = dag.marked(steps, paths.where("head is not null").select("path_id", "head"))
    inside = marked.join(clusters.where("ref_url is null").select("path_id", "head", "cluster", "__prefix", "base_uri"), "path_id")
    is_dead = F.col("headed") & ~F.col("active")
    drawn = dag.cut(inside if dead else inside.where(~is_dead))
    kind = F.when(F.col("step_id") == F.col("head"), "head").when(is_dead, "dead").otherwise("step")
    name = F.coalesce("actor_name", X.actor_name("actor")) if "actor_name" in steps.columns else X.actor_name("actor")
    lines = [F.array("step_id", name), F.array(X.title("intent", 30))]
    if timestamps:
        lines.append(F.array(F.substring("ts", 12, 8)))
    if files:
        lines.append(F.transform(F.map_keys("change"), lambda f: X.title(f, 28)))
    label_text = F.array_join(F.array_compact(F.concat(*lines)), "\n")
    nodes = drawn.select("cluster", "path_id", F.concat("__prefix", "step_id").alias("node_id"), "step_id", kind.alias("kind"), label_text.alias("label"))
    each = drawn.select("path_id", "__prefix", F.col("step_id").alias("child"), F.col("active").alias("__on"), F.explode("parents").alias("parent"))
    known = drawn.select("path_id", F.col("step_id").alias("parent"), F.col("active").alias("__parent_on")).groupBy("path_id", "parent").agg(F.max("__parent_on").alias("__parent_on"))
    links = each.join(known, ["path_id", "parent"]).select("path_id", F.concat("__prefix", "parent").alias("source"), F.concat("__prefix", "child").alias("target"), F.when(F.col("__on") & F.col("__parent_on"), "on").otherwise("off").alias("kind"))
    from_base = drawn.where("size(parents) = 0 and base_uri is not null").select("path_id", F.concat("__prefix", F.lit("__BASE__")).alias("source"), F.concat("__prefix", "step_id").alias("target"), F.lit("base").alias("kind"))
    return bases.unionByName(refs).unionByName(nodes), links.unionByName(from_base)


def numbered(rows: DataFrame, order: list, key: str = "path_id") -> DataFrame:
    """Rows with ord, their place among those of their key."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def drawings(documents: DataFrame, timestamps: bool = False, files: bool = True, dead: bool = True) -> DataFrame:
    """(uri, dot) of documents (uri, raw): a step alone, a path, or a graph with its paths as clusters.

    Documents that can't be read have no drawing.
    """
    kinds = D.parse(documents).where("error is null").select("uri", "kind")
    rows, paths = dag.cut(D.steps(documents).join(kinds, "uri")), dag.cut(D.paths(documents).join(kinds, "uri"))
    of = lambda df, kind: df.where(F.col("kind") == kind).drop("kind")
    by_uri = lambda df, key: df.withColumn(key, F.col("uri"))
    line = lambda df, key: df.select(F.col(key).alias("uri"), F.col("section").cast("long").alias("section"), F.col("ord").cast("long").alias("ord"), "line")
    steps_alone = line(step_lines(by_uri(of(rows, "Step"), "path_id"), timestamps, files), "path_id")
    paths_alone = line(path_lines(by_uri(of(paths, "Path"), "path_id"), by_uri(of(rows, "Path"), "path_id"), timestamps, files, dead), "path_id")
    graphs = line(graph_lines(by_uri(D.scoped(of(paths, "Graph")), "graph_id"), by_uri(D.scoped(of(rows, "Graph")), "graph_id"), timestamps, files, dead), "graph_id")
    return joined(steps_alone.unionByName(paths_alone).unionByName(graphs), "uri")
