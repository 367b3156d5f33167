"""Payroll: compensation, overtime, and what pay policies would save.

Every function takes the cleaned payroll table: ``fiscal_year, agency_name,
first_name, mid_init, last_name, position, base_salary, gross_paid,
overtime_paid, additional_pay, regular_hours, overtime_hours, pay_basis,
start_date, work_location``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions.numbers import tiered_pay
from ..functions.text import title_case
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..operators.reshape import pivot_longer
from ..sources.delimited import read_csv

# Columns of the published payroll table and their names here.
SCHEMA = (
    "fiscal_year int, payroll_number string, agency_name string, last_name string, first_name string, mid_init string, "
    "agency_start_date date, work_location_borough string, title_description string, leave_status_as_of_june_30 string, "
    "base_salary double, pay_basis string, regular_hours double, regular_gross_paid double, ot_hours double, "
    "total_ot_paid double, total_other_pay double"
)
NAMES = {
    "agency_start_date": "start_date",
    "work_location_borough": "work_location",
    "title_description": "position",
    "leave_status_as_of_june_30": "leave_status",
    "regular_gross_paid": "gross_paid",
    "ot_hours": "overtime_hours",
    "total_ot_paid": "overtime_paid",
    "total_other_pay": "additional_pay",
}
TITLED = ["agency_name", "last_name", "first_name", "work_location_borough", "title_description", "leave_status_as_of_june_30"]
# "Queen" is the list's own spelling, so Queens counts as outside.
CITY = ["Brooklyn", "Bronx", "Queen", "Manhattan", "Staten Island"]
TOP_POST = "Mayor"
NEVER_STARTED = "9999-12-31"


def load(spark: SparkSession, path: str) -> DataFrame:
    return clean(read_csv(spark, path, SCHEMA))


def clean(raw: DataFrame) -> DataFrame:
    titled = raw.withColumns({c: title_case(c) for c in TITLED})
    return paid(titled.withColumnsRenamed(NAMES))


def paid(pay: DataFrame) -> DataFrame:
    return pay.where(F.col("gross_paid") >= 0)


def total_pay() -> Column:
    return F.col("base_salary") + F.col("overtime_paid")


def career(pay: DataFrame, first: str, middle: str, last: str) -> DataFrame:
    person = (F.col("first_name") == first) & (F.col("mid_init") == middle) & (F.col("last_name") == last)
    earned = F.col("gross_paid") + F.col("overtime_paid") + F.col("additional_pay")
    return (
        pay.where(person)
        .groupBy("fiscal_year", "agency_name")
        .agg(M.sum0(earned).alias("total_salary"), A.join_distinct("position").alias("position"))
    )


def compensation(pay: DataFrame, exempt: str = TOP_POST) -> DataFrame:
    due = tiered_pay("base_salary", "regular_hours", "overtime_hours", F.col("position") == exempt)
    return pay.withColumn("total_compensation", due)


def top_position(pay: DataFrame) -> DataFrame:
    means = pay.groupBy("position").agg(F.avg("base_salary").alias("mean_base"))
    return R.top_n(means, 1, M.desc("mean_base"), F.asc("position"))


def top_person(pay: DataFrame, tie: Sequence[str]) -> DataFrame:
    return R.top_n(pay.withColumn("total_payroll", total_pay()), 1, M.desc("total_payroll"), *map(F.asc, tie))


def most_overtime(pay: DataFrame, n: int = 6) -> DataFrame:
    who = ["fiscal_year", "agency_name", "position", "first_name", "last_name"]
    most = pay.groupBy(*who).agg(F.max("overtime_hours").alias("total_overtime"))
    return R.top_n_ties(most, "total_overtime", n)


def agency_means(pay: DataFrame, n: int = 10) -> DataFrame:
    means = pay.groupBy("fiscal_year", "agency_name").agg(F.avg(total_pay()).alias("mean_payroll"))
    return R.top_n(means, n, M.desc("mean_payroll"), F.asc("fiscal_year"), F.asc("agency_name"))


def biggest_agencies(pay: DataFrame) -> DataFrame:
    heads = pay.groupBy("fiscal_year", "agency_name").agg(F.count("*").alias("employees"))
    return R.top_per_group(heads, ["fiscal_year"], 1, F.desc("employees"), F.asc("agency_name"))


def hours_against_overtime(pay: DataFrame) -> DataFrame:
    """The agency with most regular hours, beside its overtime if it leads there too."""
    means = pay.groupBy("agency_name").agg(
        F.avg("regular_hours").alias("mean_regular"), F.avg("overtime_hours").alias("mean_overtime")
    )
    regular = R.top_n(means.select("agency_name", "mean_regular"), 1, M.desc("mean_regular"), F.asc("agency_name"))
    overtime = R.top_n(means.select("agency_name", "mean_overtime"), 1, M.desc("mean_overtime"), F.asc("agency_name"))
    return J.join(regular, overtime, ["agency_name"], few=True)


def outside(pay: DataFrame, city: Sequence[str] = CITY) -> DataFrame:
    rows = pay.where(~F.col("work_location").isin(list(city)))
    means = rows.groupBy("work_location").agg(F.avg("base_salary").alias("mean_base"))
    return means.orderBy(M.desc("mean_base"), "work_location")


def growth(pay: DataFrame, old: int, new: int) -> DataFrame:
    return A.growth(pay, "fiscal_year", F.col("base_salary"), old, new)


def limit_per_year(pay: DataFrame, post: str = TOP_POST) -> DataFrame:
    """What the named post costs each year; one row per year."""
    return pay.where(F.col("position") == post).groupBy("fiscal_year").agg(M.sum0(total_pay()).alias("limit_pay"))


def _others(pay: DataFrame, post: str) -> DataFrame:
    return pay.where(F.col("position") != post)


def _reaching(pay: DataFrame, post: str, limits: DataFrame | None) -> DataFrame:
    """Records of other posts that reach the year's limit (by default, what the post costs)."""
    limits = limit_per_year(pay, post) if limits is None else limits
    return J.at_least(_others(pay, post), limits, ["fiscal_year"], total_pay(), "limit_pay")


def above_limit(pay: DataFrame, post: str = TOP_POST, n: int = 10, limits: DataFrame | None = None) -> DataFrame:
    """Each year's best paid people among records at or above the limit."""
    high = _reaching(pay, post, limits)
    who = ["fiscal_year", "first_name", "mid_init", "last_name"]
    people = high.groupBy(*who).agg(M.sum0(total_pay()).alias("total_pay"))
    return R.top_per_group(people, ["fiscal_year"], n, M.desc("total_pay"), *[M.asc(c) for c in who[1:]])


def cap_savings(pay: DataFrame, post: str = TOP_POST) -> DataFrame:
    """Highest base of the other posts less the limit, by year, in one pass."""
    other, limited = F.col("position") != post, F.col("position") == post
    by_year = pay.groupBy("fiscal_year").agg(
        F.count_if(other).alias("_others"),
        (F.max(F.when(other, F.col("base_salary"))) - F.sum(F.when(limited, total_pay()))).alias("savings"),
    )
    return by_year.where(F.col("_others") > 0).drop("_others")


def above_limit_detail(
    pay: DataFrame, post: str = TOP_POST, n: int | None = 10, limits: DataFrame | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """Agency and position of the same records; ``n=None`` keeps all of them."""
    rows = _reaching(pay, post, limits).withColumn("employee_pay", total_pay())
    if n is not None:
        rows = R.top_per_group(rows, ["fiscal_year"], n, M.desc("employee_pay"), *map(M.asc, [*tie, "agency_name", "position"]))
    return rows.select("agency_name", "position", "fiscal_year", "employee_pay", "limit_pay")


def overtime_totals(pay: DataFrame) -> DataFrame:
    worked = pay.where(F.col("overtime_hours") != 0)
    totals = worked.groupBy("agency_name", "position", "fiscal_year").agg(M.sum0("overtime_hours").alias("overtime"))
    return totals.orderBy(M.desc("fiscal_year"), M.desc("overtime"), "agency_name", "position")


def salaried_and_hourly(pay: DataFrame, salaried: str = "per Annum") -> DataFrame:
    """Salaried records without overtime and other records with overtime, by year."""
    yearly = F.col("pay_basis") == salaried
    counts = pay.groupBy("fiscal_year").agg(
        F.count_if(yearly & (F.col("overtime_hours") == 0)).alias("full_time"),
        F.count_if(~yearly & (F.col("overtime_hours") > 0)).alias("part_time"),
    )
    return counts.where((F.col("full_time") > 0) | (F.col("part_time") > 0)).orderBy("fiscal_year")


def overtime_by_year(pay: DataFrame) -> DataFrame:
    return pay.groupBy("fiscal_year").agg(M.sum0("overtime_hours").alias("overtime"), F.count("*").alias("employees"))


def overtime_by_year_long(pay: DataFrame) -> DataFrame:
    return pivot_longer(overtime_by_year(pay), ["fiscal_year"], ["overtime", "employees"], "metric", "value")


def overtime_correlation(pay: DataFrame) -> DataFrame:
    return overtime_by_year(pay).agg(F.corr("employees", "overtime").alias("corr"))


def overtime_saving() -> Column:
    return F.col("overtime_hours") * (F.col("base_salary") - F.col("overtime_paid"))


def recent_savings(pay: DataFrame, since: str, never: str = NEVER_STARTED) -> DataFrame:
    start = F.col("start_date")
    recent = pay.where((start >= F.to_date(F.lit(since))) & (start != F.to_date(F.lit(never))))
    sums = recent.groupBy("fiscal_year", "agency_name").agg(M.sum0(overtime_saving()).alias("savings"))
    return sums.orderBy("fiscal_year", "agency_name")


def policy_savings(pay: DataFrame, hourly: str = "per Hour") -> DataFrame:
    """Largest saving per agency and year, hourly records left out."""
    rows = pay.where(~M.matches("pay_basis", hourly)).withColumn("saving", overtime_saving())
    best = rows.where(F.col("saving") != 0).groupBy("fiscal_year", "agency_name").agg(F.max("saving").alias("savings"))
    return best.orderBy("fiscal_year", "agency_name")
