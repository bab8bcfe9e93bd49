"""A messy table made from ``customer`` by arithmetic on its key, in SQL that Spark and DuckDB read alike.

It has what the clean tables lack, so every check has something to find. ``rid`` numbers rows; each 300th row
comes a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .frame import AuditFrame
from .shared import saved

AS_OF = "2026-01-01"
DATE = "cast(date '{0}' + cast({1} as int) as string)"

COLUMNS = {
    "participant_id": "'P' || lpad(cast(k as string), 6, '0')",
    "first_name": "case when k % 61 = 0 then 'An​na' when k % 71 = 0 then 'JosÃ©' else case k % 5 when 0 then 'Anna' when 1 then 'Ben' when 2 then 'Carla' when 3 then 'Dev' else 'Emma' end || case when k % 2 = 0 then '' else 'lee' end end",
    "age": "case when k % 211 = 0 then '-3' when k % 197 = 0 then '340' else cast(18 + (k * 7) % 72 as string) end",
    "sex": "case when k % 103 = 0 then 'M' when k % 101 = 0 then (case when k % 2 = 0 then 'female' else 'male' end) when k % 2 = 0 then 'Female' else 'Male' end",
    "income": "case when 18 + (k * 7) % 72 >= 65 and k % 5 < 3 then '' when k % 67 = 0 then '9999' when k % 131 = 0 then '$' || cast(20 + k % 70 as string) || ',500' else cast(20000 + (k * 7919) % 130000 as string) end",
    "state": "case when k % 97 = 0 then ' NY ' when k % 83 = 0 then 'TX' when k % 3 = 0 then 'NY' when k % 3 = 1 then 'MA' else 'California' end",
    "zip": "case when k % 3 = 1 then (case when k % 89 = 0 then cast(1000 + k % 900 as string) else '0' || cast(1000 + k % 900 as string) end) when k % 3 = 0 then cast(10000 + k % 900 as string) when k % 149 = 0 then '9021' || 'A' else cast(90000 + k % 900 as string) end",
    "county_fips": "case when k % 151 = 0 then '1A' else lpad(cast(1000 + k % 50 as string), 5, '0') end",
    "weight_kg": "case when k % 20 = 0 then cast(cast(floor(round((600 + (k * 17) % 150) * 2.20462) / 10) as bigint) as string) || '.' || cast(cast(round((600 + (k * 17) % 150) * 2.20462) as bigint) % 10 as string) else cast(cast(floor((600 + (k * 17) % 150) / 10) as bigint) as string) || '.' || cast((600 + (k * 17) % 150) % 10 as string) end",
    "birth_date": DATE.format("1950-01-01", "(k * 37) % 12000"),
    "admission_date": "case when k % 107 = 0 then '45000' when k % 127 = 0 then '03/04/2024' else " + DATE.format("2023-01-01", "(k * 13) % 360") + " end",
    "discharge_date": "case when k % 109 = 0 then '2022-06-01' else " + DATE.format("2024-02-01", "(k * 13) % 300 + case when (k * 13) % 300 > 200 then 400 else 0 end") + " end",
    "visit_date": "case when k % 113 = 0 then '2099-01-15' when k % 199 = 0 then '1949-03-01' else " + DATE.format("2024-03-01", "(k * 11) % 300") + " end",
    "poverty_score": "cast(least(100 + (k * 13) % 700, 500) as string)",
    "mother_age": "cast(1940 + k % 60 as string)",
    "has_spouse": "case when k % 2 = 0 then 'Yes' else 'No' end",
    "spouse_name": "case when k % 2 = 0 or k % 79 = 0 then 'Sam' || cast(k % 9 as string) else '' end",
    "site_id": "case when k % 137 = 0 then cast(7 + k % 3 as string) else lpad(cast(k % 40 as string), 4, '0') end",
    "account_id": "case when k % 139 = 0 then '1.23457E+11' else cast(123456000000 + k as string) end",
    "latitude": "case when k % 157 = 0 then '120.5' when k % 163 = 0 then '200.5' else cast(20 + k % 40 as string) || '.25' end",
    "longitude": "case when k % 163 = 0 then '-300.5' else '-' || cast(70 + k % 20 as string) || '.75' end",
    "body_temp": "case when k % 25 = 0 then cast(97 + k % 4 as string) || '.5' else cast(36 + k % 2 as string) || '.5' end",
    "cost_lab": "cast(100 + (k * 31) % 900 as string)",
    "cost_drug": "cast(50 + (k * 17) % 700 as string)",
    "cost_total": "cast(150 + (k * 31) % 900 + (k * 17) % 700 + case when k % 173 = 0 then 25 else 0 end as string)",
    "updated_at": "case when k % 179 = 0 then '2024-05-01T25:10:00Z' when k % 167 = 0 then '2024-05-01 10:10:00' when k % 11 = 0 then '2024-05-01T10:10:00+02:00' else '2024-05-01T10:' || lpad(cast(k % 60 as string), 2, '0') || ':00Z' end",
    "sample_wt": "cast(1 + k % 7 as string)",
    "pulse_reading": "case when k % 10 < 7 then cast(60 + 5 * (k % 12) as string) else cast(60 + (k * 7) % 97 as string) end",
    "code_a": "'c' || cast(k % 6 as string)",
    "code_b": "cast((k % 6) * 11 as string)",
    "batch": "'B1'",
    "memo": "case when k % 73 = 0 then 'call 555-123-4567' when k % 59 = 0 then 'asdf' when k % 53 = 0 then 'seen by Dr. Patel' when k % 47 = 0 then 'lives at 12 Elm Street' else 'note ' || chr(cast(97 + k % 26 as int)) || ' entry ' || cast(k as string) end",
    "remark": "case when k % 9 = 0 then rpad('cut text ' || cast(k as string) || ' ', 50, 'xyz') when k % 4 = 0 then '' else 'short text ' || cast(k as string) end",
    "second_remark": "case when k % 4 = 0 then '' else 'seen ' || cast(k % 1000 as string) end",
    "region_name": "case when k = 17 then 'Nrth' when k % 2 = 0 then 'North' when k % 3 = 0 then 'SOUTH' else 'South' end",
    "grade": "case when k = 19 then 'Z' when k % 3 = 0 then 'A' when k % 3 = 1 then 'B' else 'C' end",
    "level": "case when k = 21 then 'low' when k % 3 = 0 then 'high' else 'low' end",
}

#: Repeated records of persons, three a person; h is the person that a person's details are copied from.
VISITS = {
    "patient_id": "'T' || lpad(cast(g as string), 6, '0')",
    "encounter_id": "'E' || lpad(cast(case when k % 401 = 400 then k - 1 else k end as string), 7, '0')",
    "full_name": "case when g % 50 = 2 then 'Alexandra Quill' || cast(h as string) || 'n' else 'Alexandra Quill' || cast(h as string) end",
    "birth_date": "case when k % 83 = 0 then '1944-04-04' else " + DATE.format("1950-01-01", "(h * 37) % 12000") + " end",
    "zip": "cast(10000 + h % 900 as string)",
    "visit_date": DATE.format("2023-01-01", "(k % 3) * 100 + h % 50"),
    "age": "case when k % 211 = 2 then '20' else cast(30 + h % 40 + k % 3 as string) end",
    "sex": "case when h % 2 = 0 then (case when k % 3 = 1 then 'Female' else 'F' end) else (case when k % 97 = 1 then 'F' else 'M' end) end",
    "_overflow": "case when k % 181 = 0 then 'extra' || cast(k as string) else '' end",
}


def visits_sql(customer: str) -> str:
    cells = ", ".join(f"{e} as {c}" for c, e in VISITS.items())
    g = f"select c_custkey as k, cast(floor(c_custkey / 3) as bigint) as g from {customer}"
    return f"select k as rid, {cells} from (select *, case when g % 50 in (1, 2) then g - g % 50 else g end as h from ({g}) u) t"


_MADE: dict[tuple, DataFrame] = {}


def made(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The table that ``sql`` makes of ``customer``, written once a session: queries read it as they would any input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
        parts = max(spark.sparkContext.defaultParallelism, customer.rdd.getNumPartitions())
        customer = customer.repartition(parts, "c_custkey")  # a small file of keys is one task, and so would be the wide rows made of them
        _MADE[key] = saved(spark.sql(sql, customer=customer).withColumnRenamed("rid", "_rid"), name)
    return _MADE[key]


def visits(spark: SparkSession, sf_dir: str) -> AuditFrame:
    return AuditFrame(made(spark, sf_dir, "visits", visits_sql("{customer}")), as_of=AS_OF)


def intake_sql(customer: str) -> str:
    cells = ", ".join(f"{e} as {c}" for c, e in COLUMNS.items())
    rows = f"(select c_custkey as k from {customer}) t"
    return f"select k as rid, {cells} from {rows} union all select k + 1000000000 as rid, {cells} from {rows} where k % 300 = 0"


def intake(spark: SparkSession, sf_dir: str) -> AuditFrame:
    return AuditFrame(made(spark, sf_dir, "intake", intake_sql("{customer}")), as_of=AS_OF, primary_key=["participant_id"])
