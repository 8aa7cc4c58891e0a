"""Layout of pages from glyphs and lines: columns, lines, repeated headers, cells; all windows are by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_columns(glyphs: DataFrame, width: float, page: list[str]) -> DataFrame:
    """(*page, clusters, columns): column clusters against the glyph before, and columns against everything before.

    A new one begins where the gap is over 4 % of the width, 2 at least.
    """
    order = Window.partitionBy(*page).orderBy("x0", "x1", "glyph_id")
    least = max(0.04 * width, 2.0)
    breaks = glyphs.select(*page, (F.col("x0") - F.lag("x1").over(order) > least).alias("a"), (F.col("x0") - F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)) > least).alias("b"))
    one = lambda c: (F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")) + 1)
    return breaks.groupBy(*page).agg(one("a").alias("clusters"), one("b").alias("columns"))


def page_lines(glyphs: DataFrame, page: list[str]) -> DataFrame:
    """(*page, line, glyphs, x0, x1, font): a new line where the step down is over 0.3 of the median font, 2 at least."""
    by = Window.partitionBy(*page)
    order = by.orderBy("top", "x0", "glyph_id")
    step = F.col("top") - F.lag("top").over(order) > F.greatest(0.3 * F.percentile("font", 0.5).over(by), F.lit(2.0))
    marked = glyphs.withColumn("_s", F.coalesce(step, F.lit(False)).cast("int")).withColumn("line", F.sum("_s").over(order) + 1)
    return marked.groupBy(*page, "line").agg(F.count("*").alias("glyphs"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.round(F.avg("font"), 6).alias("font"))


def line_text(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, text): glyphs in order of x0, a blank where the gap is over a quarter of the font, 1 at least."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "x1", "text", "font")))
    joined = F.aggregate(
        "parts", F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("end")),
        lambda acc, g: F.struct(F.concat(acc["t"], F.when(acc["end"].isNotNull() & (g["x0"] - acc["end"] > F.greatest(F.lit(0.25) * g["font"], F.lit(1.0))), " ").otherwise(""), g["text"]).alias("t"), g["x1"].alias("end")),
        lambda acc: acc["t"],
    )
    return glyphs.groupBy(*by).agg(parts.alias("parts")).select(*by, joined.alias("text"))


def repeated_lines(lines: DataFrame, owner: str, height: float) -> DataFrame:
    """(owner, key, band, pages): texts in the top or bottom 8 % of at least two and half of the owner's pages."""
    band = F.when(F.col("top") < 0.08 * height, "top").when(F.col("top") > 0.92 * height, "bottom")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "#"), r"[ \t]+", " "))
    edge = lines.select(owner, "page", band.alias("band"), key.alias("key")).where("band is not null and key <> '' and page is not null")
    pages = lines.where("page is not null").groupBy(owner).agg(F.count_distinct("page").alias("all"))
    by = edge.groupBy(owner, "key", "band").agg(F.count_distinct("page").alias("pages")).where("pages > 1")
    return by.join(pages, owner).where("pages * 2 >= all").select(owner, "key", "band", "pages")


def outside_cells(glyphs: DataFrame, cells: DataFrame, page: list[str]) -> DataFrame:
    """Glyphs that overlap no table cell of their page: an anti join by page with the overlap as condition."""
    g, c = glyphs.alias("g"), cells.alias("c")
    same = [F.col(f"g.{p}") == F.col(f"c.{p}") for p in page]
    over = (F.col("g.x0") < F.col("c.cx1")) & (F.col("g.x1") > F.col("c.cx0")) & (F.col("g.top") < F.col("c.cbottom")) & (F.col("g.top") + F.col("g.font") > F.col("c.ctop"))
    condition = over
    for s in same:
        condition = condition & s
    return g.join(c, condition, "left_anti")
