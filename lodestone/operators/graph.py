"""Property graph: link extraction, traversal and expansion of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITED_DOI, MARKDOWN_LINK, WIKILINK, stable_id, strip
from ..shared import store


def file_node_id(path: Column) -> Column:
    return stable_id(path, F.lit("file"))


def extract_links(df: DataFrame, path_col: str = "source_path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of wikilinks, relative Markdown links (references) and DOIs after ``doi:`` or ``doi.org/`` (cites);
    each target once a file."""
    trimmed = lambda xs: F.transform(xs, lambda x: strip(x))
    text = F.coalesce(F.col(text_col), F.lit(""))
    wiki = trimmed(F.regexp_extract_all(text, F.lit(WIKILINK), 1))
    links = F.filter(trimmed(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), 2)), lambda h: ~h.rlike(r"^(?:https?://|mailto:|#)"))
    dois = trimmed(F.regexp_extract_all(text, F.lit(CITED_DOI), 1))
    tagged = lambda xs, kind, edge: F.transform(xs, lambda x: F.struct(x.alias("target"), F.lit(kind).alias("kind"), F.lit(edge).alias("edge_type")))
    each = df.select(F.col(path_col).alias("source_path"), F.posexplode(F.concat(tagged(wiki, "link_target", "references"), tagged(links, "link_target", "references"), tagged(dois, "doi", "cites"))).alias("order", "l"))
    each = each.select("source_path", "order", "l.*").where("target != ''")
    first = F.row_number().over(Window.partitionBy("source_path", "target").orderBy("order"))
    each = each.withColumn("n", first).where("n = 1").withColumn("dst_id", stable_id(F.col("target"), F.col("kind")))
    nodes = each.select(F.col("dst_id").alias("node_id"), F.col("kind").alias("node_type"), F.col("target").alias("label"), F.when(F.col("kind") == "doi", F.lit("")).otherwise(F.col("target")).alias("source_path")).distinct()
    edges = each.select(file_node_id(F.col("source_path")).alias("src_id"), "dst_id", "edge_type", F.lit(1.0).alias("weight"))
    return nodes, edges


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, target) of the links of raw pages, each once; anchors and other schemes are left out."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r'<a\s[^>]*?href="([^"#]+)"'), 1))
    return pages.select(id_col, F.explode(F.filter(found, lambda x: ~x.rlike("^(?:mailto|javascript):"))).alias("target"))


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_hops: int = 2, edge_types: list[str] | None = None, key: str = "query_id") -> DataFrame:
    """(key, node_id, hops): breadth first in both directions, each node once with its least number of hops.

    Start ids that are no nodes are ignored. Edges are stored in both directions once, and every hop is one join of the
    frontier with them, which is broadcast while it is small; visited nodes are taken out before the next hop, so that a
    hub is expanded once.
    """
    e = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    both = e.select(F.col("src_id").alias("u"), F.col("dst_id").alias("v")).unionByName(e.select(F.col("dst_id").alias("u"), F.col("src_id").alias("v"))).distinct()
    both = store(both, "edges") if max_hops > 1 else both
    seen = starts.select(key, F.col("node_id")).distinct().join(nodes.select("node_id").distinct(), "node_id", "left_semi").select(key, "node_id", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(both, F.col("node_id") == F.col("u")).select(key, F.col("v").alias("node_id")).distinct()
        frontier = step.join(seen.select(key, "node_id"), [key, "node_id"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.join(nodes.select("node_id").distinct(), "node_id", "left_semi").select(key, "node_id", "hops")


def expand(candidates: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int = 2, edge_types: list[str] | None = None, per_source: int = 5) -> DataFrame:
    """(query_id, cid, source_path, graph_score): the first current chunks of files that the candidates' files reach."""
    seeds = candidates.select("query_id", "source_path").distinct()
    reached = traverse(nodes, edges, seeds.select("query_id", file_node_id(F.col("source_path")).alias("node_id")), max_hops, edge_types)
    paths = reached.join(nodes, "node_id").where("source_path != ''").select("query_id", "source_path").distinct().join(seeds, ["query_id", "source_path"], "left_anti")
    found = paths.join(chunks.where(F.coalesce("is_current", F.lit(True))).select(F.col("chunk_id").alias("cid"), "source_path", "chunk_index"), "source_path")
    n = F.row_number().over(Window.partitionBy("query_id", "source_path").orderBy("chunk_index", "cid"))
    found = found.withColumn("n", n).where(F.col("n") <= per_source)
    found = found.join(candidates.select("query_id", "cid"), ["query_id", "cid"], "left_anti")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("source_path", "n"))
    return found.select("query_id", "cid", "source_path", F.round(1 / (1 + order), 9).alias("graph_score"))


def tree_rollup(files: DataFrame, path_col: str = "source_path", count_col: str = "chunks") -> DataFrame:
    """(folder, depth, files, chunks): every folder with what is anywhere below it."""
    parts = F.filter(F.split(F.col(path_col), "/"), lambda x: x != "")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("folder"), i.alias("depth")))
    each = files.select(F.explode(folders).alias("f"), F.col(count_col).alias("n")).select("f.folder", "f.depth", "n")
    return each.groupBy("folder", "depth").agg(F.count("*").alias("files"), F.sum("n").alias("chunks"))


def outline(nodes: DataFrame, max_depth: int | None = None, node_types: list[str] | None = None) -> DataFrame:
    keep = F.lit(True)
    if max_depth is not None:
        keep = keep & (F.col("depth") <= max_depth)
    if node_types is not None:
        keep = keep & F.col("node_type").isin(*node_types)
    return nodes.where(keep)


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Appended as they are; a missing weight is 1."""
    both = edges.unionByName(new, allowMissingColumns=True)
    return both.withColumn("weight", F.coalesce("weight", F.lit(1.0))) if "weight" in both.columns else both


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` (by path) with their position in reading order."""
    keys = ("start_line", "start_char", "end_line", "end_char", "depth", "node_type", "name", "node_id")
    return nodes.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy(*keys)))


def common_folder(paths: DataFrame, path_col: str = "source_path") -> DataFrame:
    """(folder): the longest folder path that all paths share; that of the least and the greatest path."""
    ends = paths.agg(F.min(path_col).alias("a"), F.max(path_col).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.transform(a, lambda x, i: x == F.get(b, i))
    first = F.coalesce(F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)), F.lit(0))
    shared = F.when(first == 0, a).otherwise(F.slice(a, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")))
    return ends.select(F.when(F.col("a").isNotNull(), F.array_join(shared, "/")).alias("folder"))
