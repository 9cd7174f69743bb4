"""Reports as Markdown and SVG text, from small result tables.

Each row of a report's table is rendered in Spark; the rows of one report are joined to one text. Tables of results have
as many rows as there are arms, strata or thresholds, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column | str, kind: str) -> Column:
    """A value as the text of a table's cell: ``text``, ``share`` (percent), ``number`` (three digits); null as a dash."""
    value = F.col(value) if isinstance(value, str) else value
    text = F.concat(F.round(value * 100).cast("long").cast("string"), F.lit("%")) if kind == "share" else F.format_string("%.3f", F.round(value.cast("double"), 3)) if kind == "number" else value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("-"))


def table_text(rows: DataFrame, columns: dict[str, tuple[str, str]], order: list[str]) -> DataFrame:
    """(report): a Markdown table of rows in order; ``columns`` maps a column to its title and kind of cell."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c, kind) for c, (_, kind) in columns.items())), F.lit(" |"))
    body = rows.select(F.struct(*order, line.alias("line")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    head = "| " + " | ".join(title for title, _ in columns.values()) + " |\n|" + "---|" * len(columns)
    return body.select(F.concat(F.lit(head), F.when(F.col("body") != "", F.concat(F.lit("\n"), F.col("body"))).otherwise("")).alias("report"))


def titled(report: DataFrame, title: str, notes: list[str] = ()) -> DataFrame:
    """A report under a title and notes."""
    return report.select(F.concat(F.lit("\n\n".join([f"# {title}", *notes]) + "\n\n"), F.col("report")).alias("report"))


def calibration_report(sweep: DataFrame, recommended: float, current: float) -> DataFrame:
    """(report) of sweep(threshold, refused_well, refused_wrongly): the trade-off at each threshold, with Youden's J and marks for the recommended and the current one."""
    mark = F.when(F.col("threshold") == recommended, " (recommended)").when(F.col("threshold") == current, " (current)").otherwise("")
    rows = sweep.select("threshold", F.concat(F.col("threshold").cast("string"), mark).alias("name"), "refused_well", "refused_wrongly", (F.col("refused_well") - F.col("refused_wrongly")).alias("j"))
    text = table_text(rows, {"name": ("Threshold", "text"), "refused_well": ("Correct refusals", "share"), "refused_wrongly": ("Over-refusals", "share"), "j": ("Youden J", "number")}, ["threshold"])
    return titled(text, "Calibration of the refusal threshold", [f"Recommended: {recommended}. Current: {current}."])


def comparison_report(metrics: DataFrame, title: str = "Comparison of the arms") -> DataFrame:
    """(report) of metrics(stratum, arm, hit_rate, mrr): a line for each stratum and arm."""
    return titled(table_text(metrics, {"stratum": ("Stratum", "text"), "arm": ("Arm", "text"), "hit_rate": ("Hit rate", "share"), "mrr": ("MRR", "number")}, ["stratum", "arm"]), title)


def verdict_report(comparisons: DataFrame, clauses: DataFrame, costs: DataFrame, title: str, summary: str, limits: list[str]) -> DataFrame:
    """(report): the summary, comparisons(axis, stratum, arm, difference, p), clauses(clause, fired), costs(arm, cost) and the limits of the study."""
    parts = [
        ("Comparisons", table_text(comparisons, {"axis": ("Axis", "text"), "stratum": ("Stratum", "text"), "arm": ("Arm", "text"), "difference": ("Difference", "number"), "p": ("p (Holm)", "number")}, ["axis", "stratum", "arm"])),
        ("Clauses", table_text(clauses, {"clause": ("Clause", "text"), "fired": ("Fired", "text")}, ["clause"])),
        ("Cost of a grounded correct answer", table_text(costs, {"arm": ("Arm", "text"), "cost": ("USD", "number")}, ["arm"])),
    ]
    out = parts[0][1].select(F.concat(F.lit(f"# {title}\n\n{summary}\n\n## {parts[0][0]}\n\n"), "report").alias("report"))
    for name, part in parts[1:]:
        out = out.crossJoin(F.broadcast(part.withColumnRenamed("report", "_more"))).select(F.concat("report", F.lit(f"\n\n## {name}\n\n"), "_more").alias("report"))
    tail = "\n\n## Limits\n\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(limits, 1))
    return out.select(F.concat("report", F.lit(tail)).alias("report"))


def bar_chart(rows: DataFrame, label: str, value: str, title: str, width: int = 400, bar: int = 20) -> DataFrame:
    """(svg): a bar for each row, of shares from 0 to 1, in order of the label."""
    every = rows.select(F.struct(F.col(label).cast("string").alias("l"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    y = lambda i: (i + 1) * (bar + 6)
    one = F.transform("x", lambda x, i: F.concat(F.lit('<rect x="120" y="'), y(i).cast("string"), F.lit('" width="'), F.round(x["v"] * width).cast("int").cast("string"), F.lit(f'" height="{bar}"/><text x="4" y="'), (y(i) + bar - 5).cast("string"), F.lit('">'), esc(x["l"]), F.lit("</text>")))
    head = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 140}" height="'), ((F.size("x") + 1) * (bar + 6) + 6).cast("string"), F.lit(f'"><text x="4" y="{bar - 4}">{title}</text>'))
    return every.select(F.concat(head, F.array_join(one, ""), F.lit("</svg>")).alias("svg"))
