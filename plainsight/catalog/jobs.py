"""Jobs study."""

from pyspark.sql import functions as F

from ..plans import bindings as B
from ..plans import jobs as X
from .registry import query

_JOBS = """
    with a0 as (select lower(p_name || ' ' || p_type) as job_title, arg_max(p_size, p_partkey) as size, count(*) as n from part where p_size < 25 group by 1),
    a as (select job_title, case when size <> 23 then size || '%' end as ai_impact, case when n <> 2 then n end as tasks from a0),
    b0 as (select p_name as other, min(p_type) as low, max(p_type) as high, count(*) as n, arg_max(p_size, p_partkey) as size, arg_max(p_brand, p_partkey) as brand from part
           where p_size >= 25 group by 1),
    b as (select other, case when size >= 30 then brand end as education_level, high as job_training, low as work_experience, n as openings from b0),
    matches as (select * from a, b where round(jaro_similarity(job_title, other), 9) >= 0.6),
    titled as (select * replace (array_to_string(list_transform(string_split(job_title, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as job_title) from matches),
    jobs as (select * from titled qualify row_number() over (partition by job_title order by other) = 1),
    rated as (select *, cast(replace(ai_impact, '%', '') as double) / 100 as ai_impact_ratio from jobs where ai_impact is not null),
    schooled as (select * from rated where education_level is not null)
    """


def _tables(t):
    return X.table(B.exposure_raw(t)), X.table(B.outlook_raw(t))


def _jobs(t):
    return X.first_matches(*_tables(t))


@query(
    "job_match",
    _JOBS + "select job_title, ai_impact, tasks, education_level, job_training, work_experience, cast(openings as varchar) as openings from titled",
)
def job_match(t):
    rows = X.match(*_tables(t))
    return rows.select("job_title", "ai_impact", "tasks", "education_level", "job_training", "work_experience", "openings")


@query("job_unique", _JOBS + "select job_title, ai_impact, tasks, education_level, job_training, cast(openings as varchar) as openings from jobs")
def job_unique(t):
    return _jobs(t).select("job_title", "ai_impact", "tasks", "education_level", "job_training", "openings")


@query("job_top_ratio", _JOBS + "select job_title, ai_impact_ratio from rated order by 2 desc, 1 limit 10")
def job_top_ratio(t):
    return X.by_ratio(_jobs(t))


@query("job_low_ratio", _JOBS + "select job_title, ai_impact_ratio from rated order by 2, 1 limit 10")
def job_low_ratio(t):
    return X.by_ratio(_jobs(t), largest=False)


@query("job_top_tasks", _JOBS + "select job_title, tasks from jobs where tasks is not null order by 2 desc, 1 limit 10")
def job_top_tasks(t):
    return X.by_tasks(_jobs(t))


@query("job_low_tasks", _JOBS + "select job_title, tasks from jobs where tasks is not null order by 2, 1 limit 10")
def job_low_tasks(t):
    return X.by_tasks(_jobs(t), largest=False)


_PROFILE = "select education_level, round({}(ai_impact_ratio), 3) as ai_impact_ratio, count(*) as n from schooled group by 1"


@query("job_edu_avg", _JOBS + _PROFILE.format("avg"))
def job_edu_avg(t):
    return X.education_profile(_jobs(t))


@query("job_edu_max", _JOBS + _PROFILE.format("max"))
def job_edu_max(t):
    return X.education_profile(_jobs(t), "max")


@query(
    "job_ratio_hist",
    _JOBS
    + """
    , s as (select min(ai_impact_ratio) as lo, (max(ai_impact_ratio) - min(ai_impact_ratio)) / 29 as w from rated)
    select cast(ceil(round((ai_impact_ratio - lo) / w, 9) - 0.5) as bigint) as bin, count(*) as n from rated, s group by 1
    """,
)
def job_ratio_hist(t):
    return X.ratio_histogram(_jobs(t))


@query(
    "job_edu_box",
    _JOBS
    + """
    , q as (select education_level as g, quantile_cont(ai_impact_ratio, 0.25) as q1, quantile_cont(ai_impact_ratio, 0.5) as q2,
                   quantile_cont(ai_impact_ratio, 0.75) as q3 from schooled group by 1),
    x as (select *, ai_impact_ratio between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from schooled join q on education_level = g)
    select g as education_level, min(case when inside then ai_impact_ratio end) as whisker_low, round(min(q1), 6) as q1, round(min(q2), 6) as median,
           round(min(q3), 6) as q3, max(case when inside then ai_impact_ratio end) as whisker_high, count(case when not inside then 1 end) as outliers
    from x group by 1
    """,
)
def job_edu_box(t):
    return X.education_box(_jobs(t)).withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("job_scatter", _JOBS + "select job_title, tasks, ai_impact_ratio from rated where tasks is not null")
def job_scatter(t):
    return X.scatter(_jobs(t))


@query(
    "job_scatter_by_edu",
    _JOBS + "select job_title, tasks, ai_impact_ratio, education_level from schooled where tasks is not null",
)
def job_scatter_by_edu(t):
    return X.scatter(_jobs(t), by_education=True)


@query(
    "job_bin2d",
    _JOBS
    + """
    , p as (select *, cast(replace(ai_impact, '%', '') as double) / 100 as ratio from titled
            where ai_impact is not null and tasks is not null and education_level is not null),
    s as (select education_level as g, min(tasks) as tl, max(tasks) as th from p group by 1),
    r as (select min(ratio) as rl, max(ratio) as rh from p)
    select education_level, cast(greatest(ceil(round(case when th > tl then (tasks - tl) / (th - tl) else 0 end * 30, 9)), 1) as bigint) as x_bin,
           cast(greatest(ceil(round((ratio - rl) / (rh - rl) * 20, 9)), 1) as bigint) as y_bin, count(*) as n
    from p join s on education_level = g, r group by 1, 2, 3
    """,
)
def job_bin2d(t):
    return X.ratio_by_tasks_grid(*_tables(t))
