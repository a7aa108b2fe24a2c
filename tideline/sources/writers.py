"""Results as files: per-point CSV, summary and metadata JSON, validation CSVs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_csv(flagged: DataFrame, path: str) -> None:
    """Samples with class, confidence and boundary flag (false where there is none)."""
    out = flagged.select(F.col("transect_id").alias("TransectID"), "distance", "red", "green", "blue", "nir", "predicted_class", "confidence", "transition_flag")
    out.write.mode("overwrite").csv(path, header=True)


def table_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def summary(classed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: totals, a struct for each transect, and the overall class distribution."""
    counts = classed.groupBy("transect_id", "predicted_class").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("start"), F.max("distance").alias("end"))
    classes = F.map_from_entries(F.collect_list(F.struct("predicted_class", "n"))).alias("classes")
    dist = counts.groupBy("transect_id").agg(classes, F.sum("n").alias("points"), F.min("start").alias("start"), F.max("end").alias("end"))
    edges = found.groupBy("transect_id").agg(F.count(F.lit(1)).alias("transitions"))
    return dist.join(edges, "transect_id", "left").fillna(0, ["transitions"])


def overall(classed: DataFrame, found: DataFrame) -> DataFrame:
    """One row: transects, points, boundaries and the points of each class."""
    by_class = classed.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"))
    dist = by_class.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicted_class", "n")))).alias("class_distribution"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
    one = classed.agg(F.countDistinct("transect_id").alias("transects")).join(dist)  # single rows
    return one.join(found.agg(F.count(F.lit(1)).alias("transitions")))


def summary_json(classed: DataFrame, found: DataFrame, path: str) -> None:
    """One JSON line a transect with its boundaries, so that no document grows with the data,
    and the totals in a document of their own under ``<path>_overall``."""
    edge = F.struct("distance", F.col("boundary_type").alias("type"), "confidence")
    edges = found.groupBy("transect_id").agg(F.array_sort(F.collect_list(edge)).alias("boundaries"))
    summary(classed, found).join(edges, "transect_id", "left").write.mode("overwrite").json(path)
    overall(classed, found).coalesce(1).write.mode("overwrite").json(f"{path}_overall")


def class_spans(segments: DataFrame) -> DataFrame:
    """Plot data: coloured background spans with their label's place."""
    return segments.select("transect_id", "start", "end", "predicted_class", "centroid")


def band_range(samples: DataFrame) -> DataFrame:
    """Plot data: the value axis of each transect, 1st percentile - 20 to 99th + 20."""
    every = samples.select("transect_id", F.explode(F.array("red", "green", "blue", "nir")).alias("v"))
    return every.groupBy("transect_id").agg((F.percentile("v", 0.01) - 20).alias("low"), (F.percentile("v", 0.99) + 20).alias("high"))


def markdown(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A report of small tables; each is cut at ``most`` rows, which the report says."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        parts += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        parts += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            parts.append(f"\nFirst {most} rows.")
    return "\n".join(parts) + "\n"


def text_report(title: str, figures: DataFrame, path: str) -> None:
    """Rows (section, name, value) as a text file, sections one after the other; there are a
    few dozen figures, whatever the data."""
    lines, section = ["=" * 80, title, "=" * 80], None
    for r in figures.orderBy("section", "name").collect():
        if r["section"] != section:
            section = r["section"]
            lines += ["", section.upper(), "-" * 80]
        lines.append(f"{r['name']:24s}{'' if r['value'] is None else format(r['value'], '.3f')}")
    figures.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def shell_line_report(verdicts: DataFrame, metrics: DataFrame, path: str) -> None:
    """Results of all transects as CSV, rates and counts of verdicts as a text file."""
    table_csv(verdicts, f"{path}/results")
    cells = F.array(*[F.struct(F.lit("metrics").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in metrics.columns])
    counts = verdicts.groupBy("result").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("verdicts").alias("section"), F.col("result").alias("name"), "value")
    text_report("Shell line validation", metrics.select(F.explode(cells).alias("_c")).select("_c.*").unionByName(counts), f"{path}/report")
