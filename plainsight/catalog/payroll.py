"""Payroll study."""

from pyspark.sql import functions as F

from ..plans import payroll as P
from ..plans.bindings import payroll
from .registry import query

POST = "1-Urgent"

_PAY = r"""
    with pay as (
      select l_orderkey, l_partkey, year(o_orderdate) as fiscal_year, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as agency_name,
             'Customer' as first_name, c_mktsegment[1] as mid_init, c_name as last_name,
             array_to_string(list_transform(regexp_extract_all(lower(o_orderpriority), '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '') as position,
             l_extendedprice as base_salary, l_extendedprice * (1 - l_discount) as gross_paid, l_extendedprice * l_tax as overtime_paid,
             l_extendedprice * l_discount as additional_pay, l_quantity as regular_hours, l_quantity * l_tax as overtime_hours,
             case l_returnflag when 'A' then 'per Annum' when 'R' then 'per Hour' else 'per Day' end as pay_basis,
             case when l_returnflag = 'N' and l_linestatus = 'O' then date '9999-12-31' else cast(l_shipdate as date) end as start_date,
             'Nation_' || c_nationkey as work_location
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      where l_extendedprice * (1 - l_discount) >= 0),
    lim as (select fiscal_year, sum(base_salary + overtime_paid) as limit_pay from pay where position = '1-Urgent' group by 1)
    """


def _pay(t):
    return P.paid(payroll(t))


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "pay_career",
    _PAY
    + """
    select fiscal_year, agency_name, round(sum(gross_paid + overtime_paid + additional_pay), 2) as total_salary,
           string_agg(distinct position, ',' order by position) as position
    from pay where first_name = 'Customer' and last_name = 'Customer#000000010' and mid_init = 'H' group by 1, 2
    union all
    select fiscal_year, agency_name, round(sum(gross_paid + overtime_paid + additional_pay), 2) as total_salary,
           string_agg(distinct position, ',' order by position) as position
    from pay where first_name = 'Customer' and last_name = 'Customer#000000001' and mid_init = 'M' group by 1, 2
    """,
)
def pay_career(t):
    pay = _pay(t)
    both = P.career(pay, "Customer", "H", "Customer#000000010").unionByName(P.career(pay, "Customer", "M", "Customer#000000001"))
    return _rounded(both, 2, "total_salary")


@query(
    "pay_comp",
    _PAY
    + """
    select l_orderkey, l_partkey, position, round(case when position = '1-Urgent' then base_salary
      when base_salary < 100 then base_salary * (regular_hours + overtime_hours * 1.5)
      when base_salary >= 100 then base_salary / 260 * (regular_hours / 7.5) end, 4) as total_compensation from pay
    """,
)
def pay_comp(t):
    rows = P.compensation(_pay(t), POST)
    return _rounded(rows.select("l_orderkey", "l_partkey", "position", "total_compensation"), 4, "total_compensation")


@query(
    "pay_top_position",
    _PAY + "select position, round(avg(base_salary), 4) as mean_base from pay group by 1 order by avg(base_salary) desc, 1 limit 1",
)
def pay_top_position(t):
    return _rounded(P.top_position(_pay(t)), 4, "mean_base")


@query(
    "pay_top_person",
    _PAY
    + """
    select fiscal_year, agency_name, position, last_name, round(base_salary + overtime_paid, 4) as total_payroll from pay
    order by base_salary + overtime_paid desc, l_orderkey, l_partkey limit 1
    """,
)
def pay_top_person(t):
    top = P.top_person(_pay(t), ["l_orderkey", "l_partkey"])
    return _rounded(top.select("fiscal_year", "agency_name", "position", "last_name", "total_payroll"), 4, "total_payroll")


@query(
    "pay_most_overtime",
    _PAY
    + """
    , m as (select fiscal_year, agency_name, position, first_name, last_name, max(overtime_hours) as total_overtime from pay group by all)
    select * from (select fiscal_year, agency_name, position, first_name, last_name, total_overtime from m
                   qualify rank() over (order by total_overtime desc) <= 6)
    """,
)
def pay_most_overtime(t):
    return P.most_overtime(_pay(t))


_AGENCY_AVG = (
    _PAY
    + """
    select fiscal_year, agency_name, round(avg(base_salary + overtime_paid), 4) as mean_payroll from pay group by 1, 2
    order by avg(base_salary + overtime_paid) desc, 1, 2 limit 10
    """
)


@query("pay_agency_avg", _AGENCY_AVG)
def pay_agency_avg(t):
    return _rounded(P.agency_means(_pay(t)), 4, "mean_payroll")


@query(
    "pay_biggest_agency",
    _PAY
    + """
    , h as (select fiscal_year, agency_name, count(*) as employees from pay group by 1, 2)
    select fiscal_year, agency_name, employees from h
    qualify row_number() over (partition by fiscal_year order by employees desc, agency_name) = 1
    """,
)
def pay_biggest_agency(t):
    return P.biggest_agencies(_pay(t))


@query(
    "pay_hours_vs_ot",
    _PAY
    + """
    , m as (select agency_name, avg(regular_hours) as r, avg(overtime_hours) as o from pay group by 1)
    select a.agency_name, round(a.r, 6) as mean_regular, round(b.o, 6) as mean_overtime
    from (select * from m order by r desc, agency_name limit 1) a left join (select * from m order by o desc, agency_name limit 1) b using (agency_name)
    """,
)
def pay_hours_vs_ot(t):
    return _rounded(P.hours_against_overtime(_pay(t)), 6, "mean_regular", "mean_overtime")


@query(
    "pay_outside_city",
    _PAY
    + """
    select work_location, round(avg(base_salary), 4) as mean_base from pay
    where work_location not in ('Nation_1', 'Nation_2', 'Nation_33', 'Nation_4', 'Nation_5') group by 1 order by 2 desc, 1
    """,
)
def pay_outside_city(t):
    city = ["Nation_1", "Nation_2", "Nation_33", "Nation_4", "Nation_5"]
    return _rounded(P.outside(_pay(t), city), 4, "mean_base")


@query(
    "pay_growth",
    _PAY
    + """
    , s as (select sum(base_salary) filter (where fiscal_year = 1996) as a, sum(base_salary) filter (where fiscal_year = 2000) as b from pay)
    select round(a, 2) as old_total, round(b, 2) as new_total, round((b - a) / a, 8) as growth_rate from s
    """,
)
def pay_growth(t):
    return _rounded(_rounded(P.growth(_pay(t), 1996, 2000), 2, "old_total", "new_total"), 8, "growth_rate")


@query("mayor_total", _PAY + "select fiscal_year, round(limit_pay, 2) as limit_pay from lim order by 1")
def mayor_total(t):
    return _rounded(P.limit_per_year(_pay(t), POST).orderBy("fiscal_year"), 2, "limit_pay")


@query(
    "pay_above_threshold",
    _PAY
    + """
    , people as (select fiscal_year, first_name, mid_init, last_name, sum(base_salary + overtime_paid) as total_pay
      from pay join (select fiscal_year, 2 * avg(base_salary + overtime_paid) as limit_pay from pay where position = '1-Urgent' group by 1) using (fiscal_year)
      where position <> '1-Urgent' and base_salary + overtime_paid >= limit_pay group by all)
    select fiscal_year, first_name, mid_init, last_name, round(total_pay, 4) as total_pay from people
    qualify row_number() over (partition by fiscal_year order by total_pay desc, first_name, mid_init, last_name) <= 10
    """,
)
def pay_above_threshold(t):
    return _rounded(P.above_limit(_pay(t), POST, limits=_limits(t)), 4, "total_pay")


def _limits(t):
    """Twice the post's mean pay: its yearly total would exceed every line item."""
    pay = _pay(t)
    return pay.where(F.col("position") == POST).groupBy("fiscal_year").agg((2 * F.avg(P.total_pay())).alias("limit_pay"))


@query(
    "pay_cap_savings",
    _PAY
    + """
    select fiscal_year, round(max(base_salary) - min(limit_pay), 2) as savings from pay left join lim using (fiscal_year)
    where position <> '1-Urgent' group by 1
    """,
)
def pay_cap_savings(t):
    return _rounded(P.cap_savings(_pay(t), POST), 2, "savings")


@query(
    "pay_above_detail",
    _PAY
    + """
    , l2 as (select fiscal_year, 2 * avg(base_salary + overtime_paid) as limit_pay from pay where position = '1-Urgent' group by 1)
    select agency_name, position, fiscal_year, round(base_salary + overtime_paid, 4) as employee_pay, round(limit_pay, 4) as limit_pay
    from pay join l2 using (fiscal_year) where position <> '1-Urgent' and base_salary + overtime_paid >= limit_pay
    qualify row_number() over (partition by fiscal_year order by base_salary + overtime_paid desc, l_orderkey, l_partkey) <= 10
    """,
)
def pay_above_detail(t):
    rows = P.above_limit_detail(_pay(t), POST, limits=_limits(t), tie=["l_orderkey", "l_partkey"])
    return _rounded(rows, 4, "employee_pay", "limit_pay")


@query(
    "pay_ot_totals",
    _PAY
    + """
    select agency_name, position, fiscal_year, round(sum(overtime_hours), 4) as overtime from pay where overtime_hours <> 0
    group by all order by fiscal_year desc, overtime desc
    """,
)
def pay_ot_totals(t):
    return _rounded(P.overtime_totals(_pay(t)), 4, "overtime")


@query(
    "pay_ft_pt_counts",
    _PAY
    + """
    select fiscal_year, count(*) filter (where pay_basis = 'per Annum' and overtime_hours = 0) as full_time,
           count(*) filter (where pay_basis <> 'per Annum' and overtime_hours > 0) as part_time from pay group by 1
    """,
)
def pay_ft_pt_counts(t):
    return P.salaried_and_hourly(_pay(t))


_BY_YEAR = _PAY + ", y as (select fiscal_year, sum(overtime_hours) as overtime, count(*) as employees from pay group by 1)\n"


@query(
    "pay_ot_headcount",
    _BY_YEAR
    + """
    select fiscal_year, 'overtime' as metric, round(overtime, 4) as value from y
    union all select fiscal_year, 'employees', cast(employees as double) from y
    """,
)
def pay_ot_headcount(t):
    return _rounded(P.overtime_by_year_long(_pay(t)), 4, "value")


@query("pay_ot_headcount_corr", _BY_YEAR + "select round(corr(employees, overtime), 6) as corr from y")
def pay_ot_headcount_corr(t):
    return _rounded(P.overtime_correlation(_pay(t)), 6, "corr")


@query(
    "pay_recent_savings",
    _PAY
    + """
    select fiscal_year, agency_name, round(sum(overtime_hours * (base_salary - overtime_paid)), 2) as savings from pay
    where start_date >= date '2000-01-01' and start_date <> date '9999-12-31' group by 1, 2
    """,
)
def pay_recent_savings(t):
    return _rounded(P.recent_savings(_pay(t), "2000-01-01"), 2, "savings")


@query(
    "pay_policy3",
    _PAY
    + """
    select fiscal_year, agency_name, round(max(overtime_hours * (base_salary - overtime_paid)), 4) as savings from pay
    where pay_basis not like '%per Hour%' and overtime_hours * (base_salary - overtime_paid) <> 0 group by 1, 2
    """,
)
def pay_policy3(t):
    return _rounded(P.policy_savings(_pay(t)), 4, "savings")
