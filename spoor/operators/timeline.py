"""Category totals and numbered timeline pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.operators import ordered
from spoor.operators.evidence import PAGE, categorize, timeline_filter


def category_totals(evidence: DataFrame) -> DataFrame:
    """Rows per category for all threads (tid -1) and per thread; thread-less rows count under 0."""
    # Counted per kind first; only these few rows are spread over their categories.
    kinds = (evidence.filter(F.col("seq") > 0).groupBy("run_id", "kind", "tid", "access")
             .agg(F.count(F.lit(1)).alias("_n")))
    per_thread = categorize(kinds).groupBy("run_id", "category", "tid").agg(F.sum("_n").alias("total"))
    every = per_thread.groupBy("run_id", "category").agg(F.sum("total").alias("total"))
    return per_thread.unionByName(every.withColumn("tid", F.lit(-1).cast("bigint")))


def recorded_threads(evidence: DataFrame) -> DataFrame:
    return (evidence.filter(F.col("kind").isin(4, 5, 6, 7, 8, 9, 11, 12, 13, 15))
            .select("run_id", "tid").distinct())


def piece_counts(evidence: DataFrame, segment: int | None = None) -> DataFrame:
    """How many rows each stretch of ``segment`` sequence numbers holds, by kind, access and thread: the postings that number
    the rows of every category. ``seq`` is the least number among them, so that filters of evidence hold for them too."""
    piece = F.expr(f"CAST(seq div {segment or ordered.SEGMENT} AS BIGINT)").alias("piece")
    return (evidence.filter(F.col("seq") > 0).groupBy("run_id", "kind", "access", "tid", piece)
            .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("rows")))


def _counted(evidence: DataFrame, postings: DataFrame | None, category: str, thread: int, segment: int | None) -> DataFrame:
    rows = timeline_filter(piece_counts(evidence, segment) if postings is None else postings, category, thread)
    return rows.groupBy("run_id", F.col("piece").alias("_seg")).agg(F.sum("rows").alias("_rows"))


def _page(rows: DataFrame, counts: DataFrame, size: int, segment: int | None) -> DataFrame:
    """The rows of one numbered page per run; ``counts`` holds the rows of every piece and the page asked for.

    Ordinals come from the pieces' counts, so only the pieces a page touches are read and ranked. The outermost of
    them (one row of two numbers) become a plain sequence filter that reaches the scan.
    """
    if size < 1:
        raise ValueError("Page size below 1")
    span = segment or ordered.SEGMENT
    run = Window.partitionBy("run_id")
    before = run.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
              .withColumn("total", F.sum("_rows").over(run))
              .withColumn("pages", F.expr(f"1 + (total - 1) div {size}"))
              .withColumn("page", F.greatest(F.lit(1), F.least("_asked", "pages"))))
    first = (F.col("page") - 1) * size
    touched = (counts.filter((F.col("_before") < first + size) & (F.col("_before") + F.col("_rows") > first))
               .select("run_id", "_seg", "_before", "total", "pages", "page"))
    edge = touched.agg(F.min("_seg").alias("low"), F.max("_seg").alias("high")).first()
    if edge["low"] is not None:
        rows = rows.filter(F.col("seq").between(edge["low"] * span, (edge["high"] + 1) * span - 1))
    local = F.row_number().over(Window.partitionBy("run_id", "_seg").orderBy("seq"))
    ranked = (rows.withColumn("_seg", F.expr(f"CAST(seq div {span} AS BIGINT)")).join(touched, ["run_id", "_seg"])
              .withColumn("ordinal", F.col("_before") + local - 1))
    return (ranked.filter((F.col("ordinal") >= first) & (F.col("ordinal") < first + size))
            .drop("_seg", "_before"))


def timeline_page(evidence: DataFrame, page: int, size: int = PAGE, *, thread: int = -1,
                  category: str = "All events", segment: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Page ``page`` (clamped to the existing pages) with page, pages, total and 0-based ordinal. With the stored
    ``postings`` (piece_counts of the same segment) nothing but them and the page's own pieces is read."""
    counts = _counted(evidence, postings, category, thread, segment).withColumn("_asked", F.lit(page).cast("bigint"))
    return _page(timeline_filter(evidence, category, thread), counts, size, segment)


def timeline_page_at(evidence: DataFrame, cursor: int, size: int = PAGE, *, thread: int = -1,
                     category: str = "All events", segment: int | None = None, postings: DataFrame | None = None) -> DataFrame:
    """The page that holds the first row at or after the cursor. Whole pieces before it are counted by their postings, the
    cursor's own piece by its rows."""
    span = segment or ordered.SEGMENT
    rows, own = timeline_filter(evidence, category, thread), cursor // span
    counts = _counted(evidence, postings, category, thread, segment)
    near = (rows.filter((F.col("seq") >= own * span) & (F.col("seq") < cursor)).groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("_near")))
    far = F.sum(F.when(F.col("_seg") < own, F.col("_rows")).otherwise(0)).over(Window.partitionBy("run_id"))
    counts = counts.withColumn("_far", far).join(near, "run_id", "left")
    counts = counts.withColumn("_asked", F.lit(1) + F.expr(f"(_far + coalesce(_near, 0)) div {size}")).drop("_far", "_near")
    return _page(rows, counts, size, segment)


def timeline_ordinals(evidence: DataFrame, segment: int | None = None) -> DataFrame:
    """Ordinal of every row in every category it belongs to: (run_id, category, seq, ordinal)."""
    rows = categorize(evidence.filter(F.col("seq") > 0).select("run_id", "kind", "seq", "tid", "access"))
    return ordered.ordinals(rows.select("run_id", "category", "tid", "seq"), ["run_id", "category"], "ordinal",
                            segment=segment)


def timeline_step(evidence: DataFrame, cursor: int, *, forward: bool, limit: int, thread: int = -1,
                  category: str = "All events", through: bool = False) -> DataFrame:
    """Next rows from the cursor on, or the rows before it (``through``: up to it), newest first."""
    rows = timeline_filter(evidence, category, thread)
    seq = F.col("seq")
    if forward:
        return rows.filter(seq >= cursor).orderBy(seq.asc()).limit(limit)
    return rows.filter(seq <= cursor if through else seq < cursor).orderBy(seq.desc()).limit(limit)


def offset_page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """OFFSET/FETCH over a filtered query in sequence order."""
    return rows.orderBy("seq").offset(offset).limit(limit)
