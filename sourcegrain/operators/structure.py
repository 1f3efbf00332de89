"""Ordered elements of documents: paragraphs, columns, pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text
from sourcegrain.operators import windows

# Points and shares.
GUTTER, BAND, BUCKET, SCAN_CHARS, SCAN_SHARE = 40.0, 20.0, 10.0, 200, 0.3


def paragraphs(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks (doc, ord, page, y0, y1, content): a new paragraph begins where the gap to the block before
    exceeds that block's height, or the page changes. Texts are joined by blanks, hyphens repaired."""
    keys, order = [doc], ["ord"]
    b = blocks.withColumn("py1", windows.previous("y1", keys, order)).withColumn("py0", windows.previous("y0", keys, order)).withColumn("pp", windows.previous("page", keys, order))
    breaks = F.col("pp").isNotNull() & ((F.col("page") != F.col("pp")) | (F.col("y0") - F.col("py1") > F.col("py1") - F.col("py0")))
    b = windows.with_islands(b, keys, order, breaks, "paragraph")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", text.repair_hyphens(F.col("content")).alias("c")))), lambda s: F.trim(s["c"])), " ")
    return b.groupBy(doc, "paragraph").agg(joined.alias("content"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def merge_across_pages(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks (doc, ord, page, content) whose sentence goes on after a page break are joined: the one
    before ends without a closing mark, the next begins in lower case; a closing hyphen goes."""
    keys, order = [doc], ["ord"]
    b = blocks.withColumn("before", windows.previous("content", keys, order)).withColumn("pp", windows.previous("page", keys, order))
    goes_on = (F.col("page") != F.col("pp")) & ~F.rlike(F.trim("before"), F.lit(r"""[.!?:;]["')\]]*$""")) & F.rlike(F.trim("content"), F.lit(r"^\p{Ll}"))
    b = windows.with_islands(b, keys, order, F.col("before").isNotNull() & ~goes_on, "paragraph")
    parts = F.sort_array(F.collect_list(F.struct("ord", F.trim("content").alias("c"))))
    joined = F.aggregate(parts, F.lit(""), lambda acc, s: F.when(acc == "", s["c"]).when(F.endswith(acc, F.lit("-")), F.concat(F.rtrim(acc, F.lit("-")), s["c"])).otherwise(F.concat_ws(" ", acc, s["c"])))
    return b.groupBy(doc, "paragraph").agg(joined.alias("content"), F.min("page").alias("page"))


def markdown_blocks(files: DataFrame, doc: str) -> DataFrame:
    """files (doc, text): page marks `<!-- ct-page N -->` set the page of the blocks after them; what
    stands before the first mark belongs to the page before it, 1 at least."""
    parts = F.split(F.col("text"), r"<!--\s*ct-page\s+\d+\s*-->", -1)
    marks = F.regexp_extract_all(F.col("text"), F.lit(r"<!--\s*ct-page\s+(\d+)\s*-->"), F.lit(1))
    x = files.select(doc, F.posexplode(parts).alias("part", "body"), marks.alias("marks"))
    first = F.greatest(F.get("marks", F.lit(0)).cast("int") - 1, F.lit(1))
    page = F.when(F.size("marks") == 0, 1).when(F.col("part") == 0, first).otherwise(F.get("marks", F.col("part") - 1).cast("int"))
    x = x.select(doc, "part", page.alias("page"), F.posexplode(F.split("body", r"\n\s*\n+")).alias("k", "block"))
    x = x.withColumn("content", text.clean_markdown(F.col("block"))).where("content <> ''")
    return x.withColumn("ord", F.row_number().over(Window.partitionBy(doc).orderBy("part", "k")) - 1).select(doc, "ord", "page", "content")


def scanned(pages: DataFrame, doc: str) -> DataFrame:
    """Documents (doc, page, content) in which enough pages hold hardly any text."""
    return pages.groupBy(doc).agg((F.avg(F.when(F.length(F.trim("content")) < SCAN_CHARS, 1.0).otherwise(0.0)) >= SCAN_SHARE).alias("is_scan"))


def column_order(elements: DataFrame, doc: str) -> DataFrame:
    """elements (doc, page, ord, x0, y1): place in reading order. The widest gap between left edges of a
    page, if it is a gutter, parts two columns; from the top (y grows upwards), then as they came;
    elements without a place come last."""
    edges = elements.where("x0 is not null").select(doc, "page", "x0").distinct()
    edges = edges.withColumn("next", windows.following("x0", [doc, "page"], ["x0"])).where(F.col("next") - F.col("x0") >= GUTTER)
    mid = edges.groupBy(doc, "page").agg(F.max_by((F.col("x0") + F.col("next")) / 2, F.struct(F.col("next") - F.col("x0"), -F.col("x0"))).alias("mid"))
    e = elements.join(mid, [doc, "page"], "left").withColumn("column", F.when(F.col("x0") >= F.col("mid"), 1).otherwise(0))
    w = Window.partitionBy(doc).orderBy("page", F.col("x0").isNull(), "column", F.desc("y1"), "ord")
    return e.withColumn("place", F.row_number().over(w) - 1).drop("mid")


def column_edges(elements: DataFrame, doc: str) -> DataFrame:
    """Left edges of the text columns from a histogram of x0 in buckets: the least, and the most
    frequent that lies ten buckets or more to its right."""
    h = elements.where("x0 is not null").groupBy(doc, F.floor(F.col("x0") / BUCKET + 0.5).alias("bucket")).agg(F.count("*").alias("n"))
    left = h.withColumn("left", F.min("bucket").over(Window.partitionBy(doc)))
    right = F.max_by(F.when(F.col("bucket") >= F.col("left") + 10, F.col("bucket")), F.when(F.col("bucket") >= F.col("left") + 10, F.struct("n", -F.col("bucket"))))
    return left.groupBy(doc).agg((F.min("bucket") * BUCKET).alias("left_edge"), (right * BUCKET).alias("right_edge"))


def two_columns(blocks: DataFrame, doc: str, page_width: float) -> DataFrame:
    """blocks (doc, page, ord, x0, y0): both halves of a page from the top, merged by height, the left
    one first where the two are within BAND points."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y0", "x0", "ord"])
        sides = [frame[frame["x0"] < page_width / 2], frame[frame["x0"] >= page_width / 2]]
        heights, at, order = [s["y0"].tolist() for s in sides], [0, 0], []
        while at[0] < len(heights[0]) or at[1] < len(heights[1]):
            left = at[1] >= len(heights[1]) or at[0] < len(heights[0]) and heights[0][at[0]] <= heights[1][at[1]] + BAND
            order.append(sides[not left].index[at[not left]])
            at[not left] += 1
        return frame.loc[order].assign(place=range(len(order)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return blocks.groupBy(doc, "page").applyInPandas(merge, fields + ", place int")


def flatten_tree(files: DataFrame) -> DataFrame:
    """files (path, text) of converter JSON: elements depth first, pages inherited, texts without
    children. One file is one tree, flattened by one task."""
    import json

    inner = ("kids", "children", "list items", "rows", "cells")

    def walk(node: object, page: int | None) -> Iterator[tuple]:
        if isinstance(node, list):
            for x in node:
                yield from walk(x, page)
        elif isinstance(node, dict):
            page = node.get("page number", node.get("page", page))
            content = node.get("content") or node.get("text")
            if isinstance(content, str) and content.strip():
                yield str(node.get("type", "")), content, page
            else:
                for name in inner:
                    yield from walk(node.get(name), page)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, raw in zip(part["path"], part["text"], strict=True):
                try:
                    tree = json.loads(raw or "null")
                except ValueError:
                    continue
                rows += [(path, k, *x) for k, x in enumerate(walk(tree, None))]
            frame = pd.DataFrame(rows, columns=["path", "ord", "element_type", "content", "page"])
            frame["page"], frame["ord"] = frame["page"].astype("Int32"), frame["ord"].astype("Int32")
            yield frame

    return files.select("path", "text").mapInPandas(run, "path string, ord int, element_type string, content string, page int")
