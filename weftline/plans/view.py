"""What is shown: contexts, sources, the graph's payload and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import SIGNALS, View
from weftline.functions.text import basename, label_of, snippet
from weftline.functions.vectors import axis_variance
from weftline.operators.graph import counts, induced, top_by_degree
from weftline.plans.prompts import CONTEXT_BLOCK, SOURCE_HEADER, render


def context_blocks(context: DataFrame) -> DataFrame:
    """Rows (query_id, n, source, block): passages grouped by source in the order sources come up, numbered through.

    context: (query_id, rank, source, position, text).
    """
    first = F.min("rank").over(Window.partitionBy("query_id", "source"))
    rows = context.withColumn("source_first", first)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("source_first", "rank"))
    head = F.col("rank") == F.col("source_first")
    rows = rows.withColumn("n", n)
    block = render(CONTEXT_BLOCK, i=F.col("n"), source=F.col("source"), pos=F.col("position"), text=F.col("text"))
    return rows.select("query_id", "n", "source", F.when(head, F.concat(render(SOURCE_HEADER, source=F.col("source")), F.lit("\n"), block)).otherwise(block).alias("block"))


def context_texts(blocks: DataFrame) -> DataFrame:
    """Rows (query_id, context): a query's blocks, which its token budget bounds, in order."""
    parts = F.array_sort(F.collect_list(F.struct("n", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda b: b["block"]), "\n").alias("context"))


def source_list(context: DataFrame, settings: View | None = None) -> DataFrame:
    """Sources of an answer by score: (query_id, source, page, score, preview, full_text, position, section_path)."""
    v = settings or View()
    return context.select(
        "query_id", basename(F.col("source")).alias("source"), "page", F.bround("score", 4).alias("score"), snippet(F.col("text"), v.preview_chars).alias("preview"), F.col("text").alias("full_text"), "position", "section_path"
    ).orderBy("query_id", F.desc("score"), "position")


def edge_view(edges: DataFrame) -> DataFrame:
    """Edges with their signals and the strongest one (ties to the earlier signal; none if all are zero)."""
    best = F.greatest(*SIGNALS)
    dominant = reduce(lambda out, s: F.when((F.col(s) == best) & (best > 0), F.lit(s)).otherwise(out), reversed(SIGNALS), F.lit(None).cast("string"))
    has = reduce(lambda a, b: a | b, (F.col(s) != 0 for s in SIGNALS))
    return edges.select("src", "dst", F.bround("weight", 4).alias("weight"), F.struct(*SIGNALS).alias("signals"), dominant.alias("dominant"), has.alias("has_signal"))


def graph_payload(chunks: DataFrame, edges: DataFrame, settings: View | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of highest degree with labels and three axes, the edges among them, and totals."""
    v = settings or View()
    nodes = chunks.select(F.col("chunk_idx").alias("id"))
    top = top_by_degree(nodes, edges, v.max_nodes)
    shown = top.join(chunks.withColumnRenamed("chunk_idx", "id"), "id")
    axes = [r["dim"] for r in axis_variance(shown.where("coords is not null").select(F.col("coords").alias("v"))).collect()]  # three rows
    axes += [d for d in range(3) if d not in axes][: 3 - len(axes)]
    at = lambda d: F.coalesce(F.get("coords", F.lit(d)), F.lit(0.0))
    view = shown.select(
        "id", label_of(F.col("text"), v.label_chars).alias("label"), "text", basename(F.coalesce("source", "doc_id")).alias("doc"), "position", "degree", "section_path", at(axes[0]).alias("sx"), at(axes[1]).alias("sy"), at(axes[2]).alias("sz")
    )
    return view, edge_view(induced(edges, top.select("id"))), counts(nodes, edges)


def payload_rows(nodes: DataFrame, edges: DataFrame, totals: DataFrame) -> DataFrame:
    """The payload as JSON, a row for each node, each edge and the totals: (part, json)."""
    as_json = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    return as_json(nodes, "node").unionByName(as_json(edges, "edge")).unionByName(as_json(totals, "totals"))


def score_buckets(scores: DataFrame) -> DataFrame:
    """Each score over the query's best, and its colour: high from .66, middle from .33, else low."""
    ratio = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("ratio", ratio).withColumn("bucket", F.when(F.col("ratio") >= 0.66, "high").when(F.col("ratio") >= 0.33, "mid").otherwise("low"))


def layout(points: DataFrame, half: float = 260.0) -> DataFrame:
    """Coordinates (id, sx, sy) scaled to +-half; a dimension without span stays in the middle."""
    out = points.crossJoin(F.broadcast(points.agg(*(f(c).alias(n + c) for c in ("sx", "sy") for n, f in (("lo", F.min), ("hi", F.max))))))  # one row
    scaled = lambda c: F.when(F.col("hi" + c) > F.col("lo" + c), ((F.col(c) - F.col("lo" + c)) / (F.col("hi" + c) - F.col("lo" + c)) - 0.5) * 2 * half).otherwise(0.0)
    return out.select("id", scaled("sx").alias("x"), scaled("sy").alias("y"))


def signal_breakdown(edges: DataFrame) -> DataFrame:
    """Each edge's positive signals, strongest first."""
    pairs = F.array(*(F.struct(F.col(s).alias("value"), F.lit(s).alias("signal")) for s in SIGNALS))
    ordered = F.sort_array(F.filter(pairs, lambda p: p["value"] > 0), asc=False)
    return edges.select("src", "dst", F.transform(ordered, lambda p: F.struct(p["signal"].alias("signal"), p["value"].alias("value"))).alias("breakdown"))
