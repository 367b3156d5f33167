"""Jobs: titles of two tables matched by similarity, and how exposed they are to automation.

``exposure`` has ``job_title, ai_impact, tasks``; ``outlook`` has ``job_title``
and the projection columns. Titles are matched in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions.text import lower_trim, percent_to_ratio, title_case
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..session import stored
from ..sources.delimited import read_csv

# The published columns, the names used here, the match distance.
EXPOSURE_SCHEMA = "`Job titiles` string, `AI Impact` string, Tasks int"
OUTLOOK_COLUMNS = [
    "Occupation Title",
    "Occupation Code",
    "Employment Change, 2023-2033",
    "Employment Percent Change, 2023-2033",
    "Occupational Openings, 2023-2033 Annual Average",
    "Median Annual Wage 2024",
    "Typical Entry-Level Education",
    "Education Code",
    "Work Experience in a Related Occupation",
    "Workex Code",
    "Typical on-the-job Training",
    "trCode",
]
OUTLOOK_UNUSED = ["Occupation Code", "Median Annual Wage 2024", "Education Code", "Workex Code", "trCode"]
NAMES = {
    "Job titiles": "job_title",
    "Occupation Title": "job_title",
    "AI Impact": "ai_impact",
    "Tasks": "tasks",
    "Typical Entry-Level Education": "education_level",
    "Typical on-the-job Training": "job_training",
    "Employment Change, 2023-2033": "employment_change",
    "Employment Percent Change, 2023-2033": "employment_percent_change",
    "Work Experience in a Related Occupation": "work_experience",
    "Occupational Openings, 2023-2033 Annual Average": "openings",
}
MAX_DIST = 0.4


def table(raw: DataFrame) -> DataFrame:
    """Drop unused columns, rename, and put titles in matching form."""
    rows = raw.drop(*OUTLOOK_UNUSED).withColumnsRenamed(NAMES)
    return rows.withColumn("job_title", lower_trim("job_title"))


def load(spark: SparkSession, exposure: str, outlook: str) -> tuple[DataFrame, DataFrame]:
    projections = ", ".join(f"`{c}` string" for c in OUTLOOK_COLUMNS)
    return table(read_csv(spark, exposure, EXPOSURE_SCHEMA)), table(read_csv(spark, outlook, projections))


def match(exposure: DataFrame, outlook: DataFrame, max_dist: float = MAX_DIST) -> DataFrame:
    """All similar pairs of the two tables, titled as in the first."""
    rows = J.fuzzy_join(exposure, outlook, "job_title", "job_title", max_dist)
    rows = rows.drop("job_title_y", "similarity").withColumnRenamed("job_title_x", "job_title")
    return rows.withColumn("job_title", title_case("job_title"))


def first_matches(exposure: DataFrame, outlook: DataFrame, max_dist: float = MAX_DIST) -> DataFrame:
    """One row per title: its first row, beside the first of its similar titles.

    Only the first similar title of each pair list is joined back, so the full
    join is never built. The result is kept, as every question starts from it.
    """
    def firsts(df: DataFrame) -> DataFrame:
        order = [M.asc(c) for c in df.columns if c != "job_title"]
        return R.first_per_key(df, ["job_title"], *order)

    pairs = J.fuzzy_pairs(exposure.select("job_title"), outlook.select("job_title"), max_dist)
    best = pairs.groupBy("left_text").agg(F.min("right_text").alias("right_text"))
    left = J.join(firsts(exposure), best, {"job_title": "left_text"}, "inner")
    right = firsts(outlook).withColumnRenamed("job_title", "other_title")
    rows = J.join(left, right, {"right_text": "other_title"}, "inner").drop("right_text")
    return stored(rows.withColumn("job_title", title_case("job_title")), "jobs")


def rated(jobs: DataFrame) -> DataFrame:
    """Titles with a known ratio, as a number."""
    known = jobs.where(F.col("ai_impact").isNotNull())
    return known.withColumn("ai_impact_ratio", percent_to_ratio("ai_impact"))


def by_ratio(jobs: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    order = M.desc("ai_impact_ratio") if largest else M.asc("ai_impact_ratio")
    return R.top_n(rated(jobs).select("job_title", "ai_impact_ratio"), n, order, F.asc("job_title"))


def by_tasks(jobs: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    known = jobs.where(F.col("tasks").isNotNull()).select("job_title", "tasks")
    return R.top_n(known, n, M.desc("tasks") if largest else M.asc("tasks"), F.asc("job_title"))


def _schooled(jobs: DataFrame) -> DataFrame:
    return rated(jobs).where(F.col("education_level").isNotNull())


def education_profile(jobs: DataFrame, how: str = "avg") -> DataFrame:
    """Mean (``avg``) or highest (``max``) ratio and number of titles per education level."""
    value = F.avg("ai_impact_ratio") if how == "avg" else F.max("ai_impact_ratio")
    rows = _schooled(jobs).groupBy("education_level").agg(F.round(value, 3).alias("ai_impact_ratio"), F.count("*").alias("n"))
    return rows.orderBy(M.desc("ai_impact_ratio"), "education_level")


def ratio_histogram(jobs: DataFrame, bins: int = 30) -> DataFrame:
    return A.histogram_bins(rated(jobs), "ai_impact_ratio", bins)


def education_box(jobs: DataFrame) -> DataFrame:
    return A.five_numbers(_schooled(jobs), ["education_level"], "ai_impact_ratio")


def scatter(jobs: DataFrame, by_education: bool = False) -> DataFrame:
    rows = rated(jobs).where(F.col("tasks").isNotNull())
    cols = ["job_title", "tasks", "ai_impact_ratio"]
    if by_education:
        rows, cols = rows.where(F.col("education_level").isNotNull()), [*cols, "education_level"]
    return rows.select(*cols)


def ratio_by_tasks_grid(exposure: DataFrame, outlook: DataFrame, bins: tuple[int, int] = (30, 20), max_dist: float = MAX_DIST) -> DataFrame:
    """Tasks against ratio over all similar pairs, per education level.

    Both tables are counted per title first, and pairs carry the product of the
    counts, so the pairs of rows are never built.
    """
    left = rated(exposure).where(F.col("tasks").isNotNull())
    left = left.groupBy("job_title", "tasks", "ai_impact_ratio").agg(F.count("*").alias("_left"))
    right = outlook.where(F.col("education_level").isNotNull())
    right = right.groupBy("job_title", "education_level").agg(F.count("*").alias("_right"))
    pairs = J.fuzzy_join(left, right, "job_title", "job_title", max_dist)
    counts = pairs.groupBy("education_level", "tasks", "ai_impact_ratio").agg(F.sum(F.col("_left") * F.col("_right")).alias("_n"))
    counts = stored(counts, "grid")
    return A.histogram_2d(counts, "education_level", "tasks", "ai_impact_ratio", bins, free_x=True, count=F.col("_n"))
