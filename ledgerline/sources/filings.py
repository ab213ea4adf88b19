"""Filings: which one is the annual report of a year, and the pages and sections of its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import headings
from ledgerline.operators import windows
from ledgerline.sources.stores import explode_columns

#: A run of bare page numbers counts if it is so long, so large a share of all, and spans so much of the blocks.
RUN_LENGTH, RUN_SHARE, RUN_SPAN = 20, 0.8, 0.5


def annual_reports(submissions: DataFrame, columns: list[str], year: str, form: str = "10-K") -> DataFrame:
    """Rows of columnar submissions that are a form of a year, with how many there are for each filer: only one is an
    answer, none or several are for the caller to refuse."""
    rows = explode_columns(submissions, columns).where((F.col("form") == form) & F.col("reportDate").startswith(year))
    counts = rows.groupBy("cik").agg(F.count("*").alias("candidates"))
    return rows.join(counts, "cik")


def page_marks(blocks: DataFrame, doc: str, position: str, text: str) -> DataFrame:
    """(doc, position, page): labelled marks where a document has any; else the longest run of bare numbers that rise by
    one, if it is long, most of them, and spans the document."""
    number = F.col(text).rlike(r"^\s*\d{1,4}\s*$")
    rows = blocks.select(doc, position, headings.page_number(F.col(text)).alias("label"), F.when(number, F.trim(text).cast("int")).alias("bare"))
    sizes = rows.groupBy(doc).agg(F.count("*").alias("blocks"), F.count("label").alias("labels"), F.count("bare").alias("bares"))
    labelled = rows.where("label is not null").select(doc, position, F.col("label").alias("page"))
    w = Window.partitionBy(doc).orderBy(position)
    bare = rows.where("bare is not null")
    starts = ~(F.col("bare") - F.lag("bare").over(w)).eqNullSafe(1)
    runs = windows.islands(bare.withColumn("_s", starts), [doc], [position], F.col("_s"), "run")
    spans = runs.groupBy(doc, "run").agg(F.count("*").alias("n"), F.min(position).alias("low"), F.max(position).alias("high"))
    best = windows.first_per_group(spans, [doc], [F.desc("n"), F.asc("run")]).join(sizes, doc)
    valid = best.where((F.col("labels") == 0) & (F.col("n") >= RUN_LENGTH) & (F.col("n") >= RUN_SHARE * F.col("bares")) & (F.col("high") - F.col("low") >= F.floor(F.col("blocks") * RUN_SPAN)))
    return labelled.unionByName(runs.join(valid.select(doc, "run"), [doc, "run"]).select(doc, position, F.col("bare").alias("page")))


def numbered(blocks: DataFrame, marks: DataFrame, doc: str, position: str) -> DataFrame:
    """Blocks with their page: a mark labels what stands before it; what follows the last mark has no page."""
    return windows.fill_back(blocks.join(marks, [doc, position], "left").withColumnRenamed("page", "_m"), [doc], [position], "_m", "page").drop("_m")


def item_sections(blocks: DataFrame, doc: str, position: str, text: str) -> DataFrame:
    """Per document and item: where its largest section starts and ends. A section reaches to the next heading of any
    item; tables of contents have headings too, but nothing between them."""
    item, _ = headings.item_heading(F.col(text))
    marked = blocks.withColumn("_item", item).withColumn("_size", F.length(text))
    marked = windows.islands(marked, [doc], [position], F.col("_item").isNotNull(), "_n")
    held = marked.groupBy(doc, "_n").agg(F.first("_item", ignorenulls=True).alias("item"), F.min(position).alias("start"), F.max(position).alias("end"), F.sum(F.when(F.col("_item").isNull(), F.col("_size")).otherwise(0)).alias("size"))
    return windows.first_per_group(held.where("item is not null and size > 0"), [doc, "item"], [F.desc("size"), F.asc("start")]).select(doc, "item", "start", "end", "size")


def section_paths(blocks: DataFrame, doc: str, position: str, level: str, title: Column, deepest: int = 6) -> DataFrame:
    """Blocks with the path of headings above them: the last heading of each level, unless a higher one came since."""
    out = blocks.withColumn("_title", title)
    w = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, deepest + 1):
        is_k = F.col(level) == k
        out = out.withColumn(f"_at{k}", F.max(F.when(is_k, F.col(position))).over(w)).withColumn(f"_t{k}", F.last(F.when(is_k, F.col("_title")), ignorenulls=True).over(w))
    higher = lambda k: F.greatest(*[F.coalesce(F.col(f"_at{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1))
    path = F.array_compact(F.array(*[F.when(F.col(f"_at{k}") > higher(k), F.col(f"_t{k}")) for k in range(1, deepest + 1)]))
    return out.withColumn("path", path).drop("_title", *[f"_at{k}" for k in range(1, deepest + 1)], *[f"_t{k}" for k in range(1, deepest + 1)])
