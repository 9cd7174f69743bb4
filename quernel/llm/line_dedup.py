"""Line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy, join_unique, let, materialize, unused

#: Largest size of the boilerplate table that is broadcast; a larger one is joined by host, the hosts of very many pages apart.
BROADCAST_BYTES = 4 << 20


def line_key(line):
    """Lines are compared without white space at their ends."""
    return F.xxhash64(F.trim(F.regexp_replace(line, r"^[\t\r ]+|[\t\r ]+$", "")))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.08, min_pages: int = 3) -> DataFrame:
    """(host, lines): hashes of the lines that stand on more than ``ratio`` of a host's pages, and on ``min_pages`` at least.

    A page is a distinct text of the host: exact copies of a page are counted once, in a line's pages as in
    the host's total, so that a group of copies does not turn its own contents into boilerplate. Null texts
    are no pages. A line's pages are counted in two steps, combined before each shuffle; a host that holds
    most rows is spread over all tasks by its lines and pages. The list of one host is bounded by the mean
    number of lines of its pages divided by ``ratio``.
    """
    pages = docs.where(F.col(text_col).isNotNull()).select(F.col(host_col).alias("host"), F.xxhash64(text_col).alias("page"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    lines = pages.select("host", "page", F.explode(keys).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= min_pages)
    return (
        counted.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
    )


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.08, min_pages: int = 3) -> DataFrame:
    """Drop each host's boilerplate lines from its texts: all columns, the text cleaned, plus n_lines and n_dropped.

    A line is boilerplate if it stands on more than ``ratio`` of its host's pages, a page being a distinct text
    (see ``boilerplate``). Lines are separated by ``\\n``; blank lines are never dropped; kept lines keep their
    order and form; a line that repeats in a text goes or stays as a whole. A null text stays null (0 lines), an
    empty text has one line, blank. A null host is a host of its own. Repeated rows stay; an empty table stays
    empty. All columns pass: where one has a new name, the new column is called with further underscores.
    """
    bad = materialize(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    size = bad.agg(F.sum(F.size("lines") * 8 + 64)).first()[0] or 0
    key = lambda host: F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))
    bad = bad.select(key("host").alias("of"), "lines")
    # the row travels as one column, so that its names cannot meet those of the work
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key(host_col).alias("of"), F.split(F.col(text_col), "\n").alias("split"))
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(bad), "of", "left")
    else:
        pages = materialize(docs.groupBy(key(host_col).alias("of")).agg(F.count("*").alias("n")), "pages")
        rows = join_unique(rows, bad, "of", pages.where(F.col("n") > heavy(docs.count())), "left")

    def good(keys: Column) -> Column:
        """The lines that stay; a text is looked through only for those of its host's that it holds."""
        blank = lambda x: F.regexp_replace(x, r"[\t\r ]+", "") == ""
        held = F.array_intersect(keys, "lines")
        return let(held, lambda own: F.when(F.size(own) > 0, F.filter("split", lambda x, i: ~F.array_contains(own, F.get(keys, i)) | blank(x))))

    rows = rows.select("row", "split", F.when(F.col("lines").isNotNull(), let(F.transform("split", line_key), good)).alias("good"))
    text = F.when(F.col("good").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join("good", "\n"))
    return rows.select(
        *((text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns),
        F.coalesce(F.size("split"), F.lit(0)).cast("int").alias(unused("n_lines", docs)),
        F.coalesce(F.size("split") - F.size("good"), F.lit(0)).cast("int").alias(unused("n_dropped", docs)),
    )
