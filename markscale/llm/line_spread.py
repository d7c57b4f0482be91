"""Removal of boilerplate lines that many sites share, in DataFrame functions only.

1. Per line hash, a HyperLogLog sketch of the sites that show the line; the partial sketches of the
   tasks merge by aggregation, so a line that stands in a third of all texts is one row per task.
2. Lines whose estimate lies near the threshold get an exact count of their distinct sites.
3. Lines on ``min_sites`` sites and more are removed from every text.

- Lines are the pieces between line feeds, compared as they are. Lines of white space only stay.
- A NULL site is no site. A NULL text stays NULL and has no lines; an empty text has one blank line.
- A text whose every line goes, as of a document copied whole to that many sites, becomes empty and its row stays: whole copies
  are for the deduplication operators to judge.
- Texts of any length are read whole; a row holds one text and the hashes of its removed lines.
- Rows alike in id and text are cleaned alike; an empty table gives an empty result.
- Result columns replace columns of the same name; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.session import materialise

MIN_SITES = 5
SKETCH_LOG2 = 12
#: Half the width of the band of exact counts: four standard errors of the sketch, and one site.
BAND_ERRORS, BAND_SITES = 4, 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def site_lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    lines = docs.select(F.col(site).cast("string").alias("site"), F.explode(lines_of(F.col(text))).alias("line"))
    return lines.where(F.col("line").rlike(r"\S")).select("site", line_hash(F.col("line")).alias("line_hash"))


def site_sketches(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """``line_hash`` and ``sketch``; sketches of several corpora merge with ``hll_union_agg``."""
    return site_lines(docs, text, site).groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LOG2)).alias("sketch"))


def boilerplate_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes of lines that at least ``min_sites`` sites show."""
    band = BAND_SITES + BAND_ERRORS * 1.04 / 2 ** (SKETCH_LOG2 / 2) * min_sites
    estimates = site_sketches(docs, text, site).select("line_hash", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = materialise(estimates.where(F.col("sites") >= min_sites - band), "line-estimates")
    near = likely.where(F.col("sites") <= min_sites + band).select("line_hash")
    exact = (
        site_lines(docs, text, site).join(near, "line_hash", "left_semi").distinct()
        .groupBy("line_hash").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return likely.where(F.col("sites") > min_sites + band).select("line_hash").unionByName(exact.select("line_hash"))


def remove_boilerplate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """Replace ``text`` by its remaining lines; add ``n_lines`` and ``n_removed``."""
    boilerplate = materialise(boilerplate_lines(docs, text, site, min_sites), "boilerplate")
    body = F.coalesce(F.col(text), F.lit(""))
    keys = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.unhex(F.md5(body.cast("binary"))).alias("__hash")]
    shown = docs.select(*keys, F.explode(F.array_distinct(lines_of(F.col(text)))).alias("line"))
    hits = shown.select("__key", "__hash", line_hash(F.col("line")).alias("line_hash")).join(boilerplate, "line_hash")
    removed = hits.groupBy("__key", "__hash").agg(F.collect_set("line_hash").alias("__removed"))
    # One plan at every size: the texts are shuffled once.
    joined = docs.select("*", *keys).join(removed.hint("merge"), ["__key", "__hash"], "left")
    lines = lines_of(F.col(text))
    kept = F.when(F.col("__removed").isNull(), lines).otherwise(
        F.filter(lines, lambda line: ~F.array_contains(F.col("__removed"), line_hash(line)))
    )
    return (
        joined.withColumn("__kept", kept)
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines") - F.size("__kept")).cast("long"))
        .withColumn(text, F.array_join("__kept", "\n"))
        .select(*docs.columns, *[c for c in ("n_lines", "n_removed") if c not in docs.columns])
    )
