"""A graph of typed nodes and edges as two tables, and what is computed over it.

nodes(id, kind, name) and edges(src, dst, type, ord): edges may repeat. Loops run on the
driver over DataFrames; each round's result is cut in the shared checkpoint folder, so that
plans stay short and a lost executor costs a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.checkpoints import cut
from lodestar.functions import text as T


def file_id(path: Column) -> Column:
    return F.concat(F.lit("f:"), path)


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat(F.lit("s:"), path, F.lit(":"), name, F.lit("@"), line.cast("string"))


def module_id(path: Column) -> Column:
    return F.concat(F.lit("m:"), path)


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Nodes by id from rows (ord, id, kind, attrs map): the first kind, and every attribute's last value."""
    kinds = rows.groupBy("id").agg(F.min_by("kind", "ord").alias("kind"))
    attrs = rows.select("id", "ord", F.explode("attrs").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    attrs = attrs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    return kinds.join(attrs, "id", "left")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst", "type").agg(F.min("ord").alias("ord"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge in either direction, once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()


def neighbors(edges: DataFrame, node: str, direction: str = "both", type: str | None = None) -> DataFrame:
    rows = edges.where(F.col("type") == type) if type else edges
    out = rows.where(F.col("src") == node).select(F.col("dst").alias("id"), "type", F.lit("out").alias("direction"))
    into = rows.where(F.col("dst") == node).select(F.col("src").alias("id"), "type", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def hubs(edges: DataFrame) -> DataFrame:
    """(id, score): import edges from file to file that arrive."""
    return edges.where((F.col("type") == "import") & F.col("src").startswith("f:") & F.col("dst").startswith("f:")).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("score"))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.min("ord").alias("first"), F.count("*").alias("n")).orderBy("first")


def meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols"))
    return a.crossJoin(edges.agg(F.count("*").alias("edges")))


def k_hop(edges: DataFrame, start: str, k: int = 1) -> DataFrame:
    """(id, hops): nodes within k undirected hops, the start at 0 even where it is unknown."""
    around = cut(both_ways(edges))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    frontier = seen
    for hop in range(1, k + 1):
        step = around.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, a: str, b: str, known: DataFrame | None = None) -> DataFrame:
    """(step, id) along a shortest undirected path, by the smallest parent at each node; no rows if there is none."""
    spark = edges.sparkSession
    none = spark.createDataFrame([], "step int, id string")
    if known is not None and known.where(F.col("id").isin(a, b)).select("id").distinct().count() < len({a, b}):
        return none
    if a == b:
        return spark.createDataFrame([(0, a)], "step int, id string")
    around = cut(both_ways(edges))
    seen = spark.createDataFrame([(a, None, 0)], "id string, parent string, hops int")
    frontier, hop = seen, 0
    while not frontier.isEmpty() and frontier.where(F.col("id") == b).isEmpty():
        hop += 1
        step = around.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = cut(seen.unionByName(frontier))
    if frontier.isEmpty():
        return none
    path, at = [], b
    while at is not None:
        path.append(at)
        at = seen.where(F.col("id") == at).first()["parent"]
    return spark.createDataFrame([(i, x) for i, x in enumerate(reversed(path))], "step int, id string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components by their smallest id.

    Labels fall along edges, and each round they also jump to their label's label, so rounds
    grow with the logarithm of the longest path.
    """
    around = cut(both_ways(edges))
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = around.join(label, around["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = label.join(near, label["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        up = lower.select(F.col("id").alias("component"), F.col("component").alias("up"))
        after = cut(lower.join(up, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component"), "was"))
        label = after.select("id", "component")
        if after.where("component <> was").isEmpty():
            return label


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 30, normalize: bool = False) -> DataFrame:
    """(id, rank) after a fixed number of rounds from a uniform start.

    A node's rank is split over all its edges out, self-loops and edges to unknown nodes
    included, but arrives only along edges between different known nodes; nodes without edges
    out share theirs with all. Repeated edges count each. ``normalize`` counts only the edges
    along which rank arrives, so that the ranks add up to 1.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ids = nodes.select("id")
    live = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = (live if normalize else edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    flows = cut(live.groupBy("src", "dst").agg(F.count("*").alias("times")).join(out.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.col("times") / F.col("out")).alias("w")))
    rank = cut(ids.join(out, "id", "left").select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for i in range(1, iterations + 1):
        spread = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("spread"))
        into = flows.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("rank")).alias("into"))
        rank = rank.select("id", "dangling").join(into, "id", "left").crossJoin(F.broadcast(spread))
        rank = rank.select("id", "dangling", ((1 - damping) / n + damping * (F.coalesce("into", F.lit(0.0)) + F.col("spread") / n)).alias("rank"))
        # Each round reads the ranks three times: uncut, plans would grow threefold a round.
        rank = cut(rank) if i < iterations else rank
    return rank.select("id", "rank")


def subgraph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 220) -> tuple[DataFrame, DataFrame]:
    """The nodes of the highest degree, and the distinct edges among them."""
    top = degree(nodes, edges).orderBy(F.desc("degree"), "id").limit(max_nodes)
    inside = edges.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst")), "dst", "left_semi")
    return top, inside.select("src", "dst", "type").distinct()


def dependents(edges: DataFrame, files: list[str], limit: int | None = 15) -> DataFrame:
    """(path): files that import, or refer to symbols of, the given files, which are themselves left out: the first ``limit``, or all."""
    to_file = F.when(F.col("dst").startswith("s:"), F.regexp_replace("dst", "^s:(.*):[^:]*@[0-9]+$", "f:$1")).otherwise(F.col("dst"))
    rows = edges.where(F.col("type").isin("import", "ref") & F.col("src").startswith("f:")).select(F.substr("src", F.lit(3)).alias("path"), F.substr(to_file, F.lit(3)).alias("target"), "ord")
    rows = rows.where(F.col("target").isin(*files) & ~F.col("path").isin(*files))
    rows = rows.groupBy("path").agg(F.min("ord").alias("first"))
    return (rows if limit is None else rows.orderBy("first", "path").limit(limit)).select("path")


def top_ranks(nodes: DataFrame, edges: DataFrame, limit: int = 10, iterations: int = 15) -> DataFrame:
    """(id, rank): the nodes of the highest ranks."""
    return page_rank(nodes, edges, iterations=iterations).orderBy(F.desc(F.round("rank", 12)), "id").limit(limit)


def largest_components(nodes: DataFrame, edges: DataFrame, limit: int = 10, names: int = 8) -> DataFrame:
    """(component, size, members): the largest components with their first few members."""
    label = cut(components(nodes, edges))
    top = label.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(limit)
    place = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    # A window with a bound on its ranks keeps only so many rows of a component in each task before the shuffle.
    some = label.join(F.broadcast(top.select("component")), "component").withColumn("k", place).where(F.col("k") <= names)
    members = some.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return top.join(members, "component").orderBy(F.desc("size"), "component")


def symbols_of_file(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """The nodes that a file defines."""
    mine = edges.where((F.col("type") == "define") & (F.col("src") == f"f:{path}")).select(F.col("dst").alias("id"))
    return nodes.join(mine, "id", "left_semi")


def by_name(nodes: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    rows = nodes.where(F.col("name") == name)
    return rows.where(F.col("kind") == kind) if kind else rows


def import_edges(resolved: DataFrame) -> DataFrame:
    """file -> file, once for each pair, from imports_to_files(src, ord, target, dst)."""
    rows = resolved.select(file_id(F.col("src")).alias("src"), file_id(F.col("dst")).alias("dst"), F.lit("import").alias("type"), "ord")
    return distinct_edges(rows)


def build(files: DataFrame, symbols: DataFrame, resolved: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an index: files and symbols; what files define, import and refer to, and what symbols contain.

    nodes(id, kind, name), edges(src, dst, type); references(path, name, target, is_cross_file).
    """
    file_nodes = files.select(file_id(F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"))
    symbol_nodes = symbols.select(symbol_id(F.col("path"), F.col("name"), F.col("line")).alias("id"), F.lit("symbol").alias("kind"), "name").distinct()
    refs = references.select(file_id(F.col("path")).alias("src"), F.col("target").alias("dst"), F.lit("ref").alias("type"))
    edges = define_edges(symbols).distinct().unionByName(contains_edges(symbols).distinct()).unionByName(import_edges(resolved).select("src", "dst", "type")).unionByName(refs.distinct())
    return file_nodes.unionByName(symbol_nodes), edges


def define_edges(symbols: DataFrame) -> DataFrame:
    """file -> symbol."""
    return symbols.select(file_id(F.col("path")).alias("src"), symbol_id(F.col("path"), F.col("name"), F.col("line")).alias("dst"), F.lit("define").alias("type"))


def contains_edges(symbols: DataFrame) -> DataFrame:
    """parent symbol -> child: the parent is the nearest one of that name above it in the file."""
    child, parent = symbols.where("parent IS NOT NULL").alias("c"), symbols.alias("p")
    near = child.join(parent, (F.col("c.path") == F.col("p.path")) & (F.col("c.parent") == F.col("p.name")) & (F.col("p.line") <= F.col("c.line")))
    near = near.groupBy("c.path", "c.name", "c.line").agg(F.max("p.line").alias("above"), F.max_by("p.name", "p.line").alias("parent"))
    return near.select(symbol_id(F.col("path"), F.col("parent"), F.col("above")).alias("src"), symbol_id(F.col("path"), F.col("name"), F.col("line")).alias("dst"), F.lit("contains").alias("type"))


def from_keys(region: DataFrame, nation: DataFrame, supplier: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of four tables as nodes, their foreign keys as import edges."""

    def node(df: DataFrame, mark: str, key: str, name: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{mark}:"), key).alias("id"), F.lit("file").alias("kind"), F.col(name).alias("name"))

    def edge(df: DataFrame, mark: str, key: str, to: str, ref: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{mark}:"), key).alias("src"), F.concat(F.lit(f"{to}:"), ref).alias("dst"), F.lit("import").alias("type"), F.concat(F.lit(f"{mark}:"), F.lpad(F.col(key).cast("string"), 12, "0")).alias("ord"))

    nodes = node(region, "r", "r_regionkey", "r_name").unionByName(node(nation, "n", "n_nationkey", "n_name")).unionByName(node(supplier, "s", "s_suppkey", "s_name")).unionByName(node(customer, "c", "c_custkey", "c_name"))
    edges = edge(nation, "n", "n_nationkey", "r", "n_regionkey").unionByName(edge(supplier, "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge(customer, "c", "c_custkey", "n", "c_nationkey"))
    return nodes, edges


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text a row: the counts, then nodes, then edges."""
    head = meta(nodes, edges).select(F.lit(0).alias("part"), F.to_json(F.struct("nodes", "edges", "files", "symbols")).alias("json"))
    return head.unionByName(nodes.select(F.lit(1).alias("part"), F.to_json(F.struct("id", "kind", "name")).alias("json"))).unionByName(edges.select(F.lit(2).alias("part"), F.to_json(F.struct("src", "dst", "type")).alias("json")))


# Shapes of kinds of nodes, colours of types of edges.
SHAPES = {"file": "box", "symbol": "ellipse", "module": "folder"}
COLORS = {"import": "#4c8bf5", "ref": "#999999", "define": "#2ec4b6", "contains": "#7ed321"}


def to_dot(nodes: DataFrame, edges: DataFrame, max_nodes: int = 2000) -> DataFrame:
    """(part, id, line): a DOT file's lines between its braces, for the first nodes by id and the edges among them."""
    some = nodes.orderBy("id").limit(max_nodes)
    inside = edges.join(some.select(F.col("id").alias("src")), "src", "left_semi").join(some.select(F.col("id").alias("dst")), "dst", "left_semi")
    quote = lambda c: F.concat(F.lit('"'), T.safe_name(c), F.lit('"'))

    def named(c: str, table: dict[str, str], other: str) -> Column:
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(c)), F.lit(other))

    label = F.regexp_replace(F.coalesce("name", "id"), '["\\\\]', "_")
    lines = some.select(F.lit(0).alias("part"), F.col("id"), F.concat(F.lit("  "), quote("id"), F.lit(' [label="'), label, F.lit('", shape='), named("kind", SHAPES, "ellipse"), F.lit("];")).alias("line"))
    arrows = inside.select(F.lit(1).alias("part"), F.concat_ws(">", "src", "dst", "type").alias("id"), F.concat(F.lit("  "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(' [color="'), named("type", COLORS, "#cccccc"), F.lit('"];')).alias("line"))
    return lines.unionByName(arrows)
