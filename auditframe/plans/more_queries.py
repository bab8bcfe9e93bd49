"""Queries of the programs over tables, rules, repairs, statistics, profile and score, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, insights, rules, statistics, tables
from . import profile
from .frame import AuditFrame
from .intake import AS_OF, COLUMNS, intake, visits
from .queries import num, over, short


def audited(spark: SparkSession, sf_dir: str, table: str, rid: str) -> AuditFrame:
    """A driver table under audit, rows numbered by an expression that is unique and grows in source order."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return AuditFrame(df.withColumn("_rid", F.expr(rid)), as_of=AS_OF)


def orders(spark: SparkSession, sf_dir: str) -> AuditFrame:
    return audited(spark, sf_dir, "orders", "o_orderkey")


def customer(spark: SparkSession, sf_dir: str) -> AuditFrame:
    return audited(spark, sf_dir, "customer", "c_custkey")


def lineitem(spark: SparkSession, sf_dir: str) -> AuditFrame:
    """Rows follow order, line, part and supplier; those that agree in all four are alike, so their order says nothing."""
    return audited(spark, sf_dir, "lineitem", "l_orderkey * 1000000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)")


def labels(spark: SparkSession, sf_dir: str) -> AuditFrame:
    return audited(spark, sf_dir, "labels", "doc_id")


def documents(spark: SparkSession, sf_dir: str) -> AuditFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return AuditFrame(df.withColumn("_rid", F.col("doc_id")), as_of=AS_OF)


RULES = {
    "primary_key": ["participant_id"],
    "columns": {"age": {"minimum": 0, "maximum": 120}, "admission_date": {"type": "date"}, "visit_date": {"type": "date", "format": "%Y-%m-%d"}},
}
EXPECTATIONS = [
    {"type": "range", "column": "age", "min": 0, "max": 120},
    {"type": "required", "column": "income"},
    {"type": "unique", "column": "participant_id"},
    {"type": "allowed_values", "column": "sex", "values": ["Female", "Male"]},
    {"type": "conditional", "when": {"column": "has_spouse", "op": "=", "value": "No"}, "then": {"column": "spouse_name", "op": "is blank"}},
]
REPAIRS = {
    "missing_values": {"income": {"9999": ""}},
    "category_mappings": {"sex": {"M": "Male", "male": "Male", "female": "Female"}},
}
FIXES = {
    "mojibake": ["first_name"],
    "invisible": ["first_name"],
    "whitespace": ["state"],
    "numeric_format": ["income"],
    "leading_zeros": {"zip": 5, "site_id": 4},
    "excel_dates": ["admission_date"],
    "units": {"weight_kg": {"boundary": 100.0, "minority_side": "high", "factor": 2.20462}},
    "outliers": {"age": {"action": "cap", "lower": 0.0, "upper": 120.0}},
    "pii_mask": ["memo"],
    "impute": {"second_remark": "none"},
}


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = intake(spark, sf_dir)
    rows, _ = cleaning.clean(f, REPAIRS, FIXES)
    return rows.select(F.col("_rid").alias("rid"), "first_name", "sex", "income", "state", "zip", "site_id", "admission_date", "weight_kg", "age", "memo", "second_remark")


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(intake(spark, sf_dir), REPAIRS, FIXES)[1]


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = intake(spark, sf_dir)
    return cleaning.safety_report(f, *cleaning.clean(f, REPAIRS, FIXES))


NUMERIC = ["age", "weight_kg", "cost_lab", "cost_drug", "cost_total"]
GROUPS = ["sex", "grade", "level", "code_a"]
IDS = ["participant_id", "zip", "county_fips", "site_id", "account_id"]
Q = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Q] = {
    "key_integrity_orders_customer": lambda s, d: tables.referential_integrity(customer(s, d), "c_custkey", orders(s, d), "o_custkey"),
    "key_integrity_documents_labels": lambda s, d: tables.referential_integrity(labels(s, d), "doc_id", documents(s, d), "doc_id"),
    "key_coverage_customer_orders": lambda s, d: tables.key_coverage(orders(s, d), "o_custkey", customer(s, d), "c_custkey"),
    "key_cardinality_orders_customer": lambda s, d: tables.key_cardinality(customer(s, d), "c_custkey", orders(s, d), "o_custkey"),
    "key_uniqueness_lineitem": lambda s, d: tables.key_uniqueness(lineitem(s, d), "l_orderkey"),
    "shared_keys_orders_customer": lambda s, d: tables.shared_keys(orders(s, d), customer(s, d)),
    "merge_left_first_match": lambda s, d: tables.merge(lineitem(s, d), "l_orderkey", orders(s, d), "o_orderkey").select("o_orderkey", "o_custkey", "l_partkey", "l_linenumber"),
    "merge_inner_documents_labels": lambda s, d: tables.merge(labels(s, d), "doc_id", documents(s, d), "doc_id", how="inner", labels=("label", "doc")).select("doc_id", "lang", "quality", "toxic"),
    "reconcile_records": lambda s, d: tables.reconcile(visits(s, d), "patient_id", visits_later(s, d), "patient_id", ["birth_date", "age", "sex"]),
    "repeated_key_consistency": lambda s, d: tables.repeated_key_consistency(visits(s, d), "patient_id", ["birth_date", "age", "sex", "zip"]),
    "crosswalk": lambda s, d: tables.crosswalk(customer(s, d), {"c_custkey": "id", "c_mktsegment": "segment"}, {"c_mktsegment": {"BUILDING": "1", "MACHINERY": "2"}}).select("id", "segment"),
    "validate_rules": lambda s, d: rules.validate(intake(s, d), RULES),
    "expectations_all": lambda s, d: rules.evaluate_expectations(intake(s, d), EXPECTATIONS),
    "clean_fix_order": repaired,
    "mutation_log": logged,
    "plan_dry_run": lambda s, d: cleaning.plan(intake(s, d), REPAIRS, FIXES),
    "safety_report": safety,
    "drop_duplicate_rows": lambda s, d: cleaning.drop_duplicates(intake(s, d), intake(s, d).wide).select("participant_id", "age"),
    "profile_dictionary": lambda s, d: profile.dictionary(intake(s, d)),
    "profile_orders": lambda s, d: profile.dictionary(orders(s, d)),
    "profile_levels": lambda s, d: profile.levels(intake(s, d), ["sex", "grade", "region_name", "state"]),
    "profile_quantiles": lambda s, d: profile.quantiles(intake(s, d), NUMERIC),
    "primary_key_candidates": lambda s, d: profile.key_candidates(customer(s, d)),
    "fingerprint": lambda s, d: profile.fingerprint(intake(s, d)),
    "drift": lambda s, d: profile.drift(customer(s, d), intake(s, d)),
    "quality_score": lambda s, d: profile.quality_score(intake(s, d)),
    "freshness": lambda s, d: profile.freshness(intake(s, d), ["visit_date", "discharge_date"]),
    "catalogue": lambda s, d: profile.catalogue(intake(s, d)),
    "association_spearman": lambda s, d: statistics.spearman(statistics.pairs_of(intake(s, d), intake(s, d).wide, ["cost_lab", "weight_kg", "age"])).select("a", "b", "n", F.round("rho", 6).alias("rho")),
    "association_eta_squared": lambda s, d: statistics.eta_squared(intake(s, d), GROUPS, NUMERIC),
    "association_cramers_v": lambda s, d: statistics.cramers_v(intake(s, d), GROUPS),
    "trend_orders": lambda s, d: statistics.trends(orders(s, d), "o_orderdate", ["o_totalprice"]),
    "trend_spearman_orders": lambda s, d: statistics.date_trends(orders(s, d), ["o_totalprice", "o_custkey"], 0.0),
    "concentration_totalprice": lambda s, d: statistics.concentration(orders(s, d), ["o_totalprice"]),
    "numeric_summaries": lambda s, d: statistics.summaries(intake(s, d), NUMERIC),
    "dominant_values": lambda s, d: statistics.dominant_values(intake(s, d)),
    "likelihood_gaps": lambda s, d: statistics.likelihood_gaps(intake(s, d), ["grade", "level"], ["level", "grade", "sex"]),
    "standardized_ratio": lambda s, d: statistics.standardized_ratio(intake(s, d), "grade", "A", "sex", "Male", "sample_wt"),
    "determines": lambda s, d: insights.determines(intake(s, d), [("code_a", "code_b"), ("code_a", "grade"), ("grade", "code_a"), ("sex", "grade")]),
    "part_of_whole": lambda s, d: insights.part_of_whole(intake(s, d), [("cost_lab", "cost_total"), ("cost_drug", "cost_lab")]),
    "within_strata_eta_squared": lambda s, d: insights.within_strata_eta_squared(intake(s, d), "cost_lab", "code_a", "grade"),
    "blank_only_where": lambda s, d: insights.blank_only_where(intake(s, d), "spouse_name", NUMERIC),
    "key_insights": lambda s, d: insights.key_insights(intake(s, d)),
    "coded_units": lambda s, d: intake(s, d).wide.select("_rid", insights.fix_coded_units(F.col("zip"), "weight_lbs", (10023.0, 10352.0, 10000.0, "kg")).alias("pounds")).withColumnRenamed("_rid", "rid"),
    "quantile_bands": lambda s, d: statistics.quantile_bands(intake(s, d), "cost_drug"),
}


def visits_later(spark: SparkSession, sf_dir: str) -> AuditFrame:
    """The visits without each person's first, to reconcile with all."""
    f = visits(spark, sf_dir)
    return AuditFrame(f.wide.where("_rid % 3 <> 0"), as_of=AS_OF)


def typed(c: str) -> str:
    """A double as the cell it becomes."""
    return f"case when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else cast({c} as varchar) end"


def dictionary_sql(columns: dict[str, str], table: str, n: str) -> str:
    cap = f"least(50, greatest(10, cast(floor(0.05 * {n}) as int)))"
    parts = []
    for c, named in columns.items():
        kind = "'id'" if named else f"case when bool_or(regexp_matches({c}, '^0[0-9]+$')) then 'id' when count(distinct nullif({c}, '')) <= {cap} then 'categorical' else 'free_text' end"
        parts.append(f"""select '{c}' as "column", count(*) as "rows", count(*) filter ({c} = '') as nulls, count(distinct case when {c} <> '' then trim({c}) end) as "unique", count(*) filter (try_cast(trim({c}) as double) = 0) as zeros, {kind} as category from {table}""")
    return " union all ".join(parts)


def mutations(*rows: tuple[str, str, str, str, str]) -> str:
    """``(column, rule, condition, original, new)``."""
    return " union all ".join(f"""select rid as "row", '{c}' as "column", {o} as original_value, {n} as new_value, '{r}' as rule from intake where {cond}""" for c, r, cond, o, n in rows)


KG = f"round_even({num('weight_kg')} / 2.20462, 2)"
MASKED = "regexp_replace(memo, '[0-9]{3}-[0-9]{3}-[0-9]{4}', '[phone]')"
PLAIN = "replace(substr(income, 2), ',', '')"
LOG = mutations(
    ("income", "missing_values", "income = '9999'", "income", "''"),
    ("income", "numeric_format", "income like '$%'", "income", PLAIN),
    ("sex", "category_mappings", "sex in ('M', 'male')", "sex", "'Male'"),
    ("sex", "category_mappings", "sex = 'female'", "sex", "'Female'"),
    ("first_name", "mojibake", "first_name like 'Jos%'", "'[personal data]'", "'[personal data]'"),
    ("first_name", "invisible", "first_name like 'An' || chr(8203) || '%'", "'[personal data]'", "'[personal data]'"),
    ("state", "whitespace", "state like ' %'", "state", "trim(state)"),
    ("zip", "leading_zeros", "regexp_full_match(zip, '[0-9]{4}')", "zip", "'0' || zip"),
    ("site_id", "leading_zeros", "length(site_id) < 4", "site_id", "lpad(site_id, 4, '0')"),
    ("admission_date", "excel_dates", "admission_date = '45000'", "admission_date", "'2023-03-15'"),
    ("weight_kg", "units", f"{num('weight_kg')} >= 100", "weight_kg", short(KG)),
    ("age", "outliers", f"{num('age')} < 0", "age", "'0'"),
    ("age", "outliers", f"{num('age')} > 120", "age", "'120'"),
    ("memo", "pii_mask", f"memo <> {MASKED}", MASKED, MASKED),
    ("second_remark", "impute", "second_remark = ''", "''", "'none'"),
)
FIXED = f"""select rid, case when first_name like 'Jos%' then 'Jos' || chr(233) else replace(first_name, chr(8203), '') end as first_name,
    case when sex in ('M', 'male') then 'Male' when sex = 'female' then 'Female' else sex end as sex,
    case when income = '9999' then '' when income like '$%' then {PLAIN} else income end as income, trim(state) as state,
    case when regexp_full_match(zip, '[0-9]{{4}}') then '0' || zip else zip end as zip, lpad(site_id, 4, '0') as site_id,
    case when admission_date = '45000' then '2023-03-15' else admission_date end as admission_date,
    case when {num("weight_kg")} >= 100 then {short(KG)} else weight_kg end as weight_kg,
    case when {num("age")} < 0 then '0' when {num("age")} > 120 then '120' else age end as age, {MASKED} as memo,
    case when second_remark = '' then 'none' else second_remark end as second_remark from intake"""


def ranked(pair: tuple[str, str]) -> str:
    a, b = pair
    return f"""select '{a}' as a, '{b}' as b, count(*) as n, round(corr(ra, rb), 6) as rho from (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as ra, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as rb
        from (select {num(a)} as x, {num(b)} as y from intake where {num(a)} is not null and {num(b)} is not null and {free(a)} and {free(b)}) p) q"""


def free(c: str) -> str:
    return f"{c} not in ('999', '9999', '777', '7777')" if c in ("cost_lab", "cost_drug", "cost_total") else "true"


def eta(measure: str, by: str) -> str:
    rows = f"(select {num(measure)} as x, {by} as g from intake where {num(measure)} is not null and {by} <> '' and {free(measure)})"
    return f"""select '{measure}' as measure, '{by}' as "by", cast(sum(n) as bigint) as n, round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (sum(ss) - sum(n * m) * sum(n * m) / sum(n)), 6) as eta2
        from (select count(*) as n, avg(x) as m, sum(x * x) as ss from {rows} r group by g having count(*) >= 5) t having count(*) >= 2"""


def cramer(a: str, b: str) -> str:
    return f"""select '{a}' as a, '{b}' as b, cast(sum(o) as bigint) as n, round(sqrt(greatest(sum(o * o / (nx * ny)) - 1, 0.0) / (least(count(distinct x), count(distinct y)) - 1)), 6) as v
        from (select x, y, cast(o as double) as o, cast(sum(o) over (partition by x) as double) as nx, cast(sum(o) over (partition by y) as double) as ny from (select {a} as x, {b} as y, count(*) as o from intake group by 1, 2) j) k"""


SQL: dict[str, str] = {
    "key_integrity_orders_customer": "select cast(o_custkey as varchar) as key, count(*) as n from orders where o_custkey not in (select c_custkey from customer) group by 1",
    "key_integrity_documents_labels": "select cast(doc_id as varchar) as key, count(*) as n from documents where doc_id not in (select doc_id from labels) group by 1",
    "key_coverage_customer_orders": "select count(distinct c_custkey) as distinct_keys, count(distinct o_custkey) as covered, round(count(distinct o_custkey) / count(distinct c_custkey), 6) as coverage from customer left join orders on o_custkey = c_custkey",
    "key_cardinality_orders_customer": "select max(n) as most, count(*) as matched, case when max(n) = 1 then 'one_to_one' else 'one_to_many' end as relation from (select o_custkey, count(*) as n from orders where o_custkey in (select c_custkey from customer) group by 1) t",
    "key_uniqueness_lineitem": "select cast(sum(n) as bigint) as total, count(*) as distinct_keys, count(*) filter (n > 1) as duplicated, cast(sum(n) filter (n > 1) as bigint) as rows_of_duplicated from (select l_orderkey, count(*) as n from lineitem group by 1) t",
    "shared_keys_orders_customer": "select 'o_custkey' as column_a, 'c_custkey' as column_b, round((select count(distinct o_custkey) from orders where o_custkey in (select c_custkey from customer)) / least((select count(distinct o_custkey) from orders), (select count(*) from customer)), 6) as overlap, 1.0::double as distinctness",
    "merge_left_first_match": """select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, cast(l_partkey as varchar) as l_partkey, cast(l_linenumber as varchar) as l_linenumber from orders left join
        (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as r from lineitem) l on l_orderkey = o_orderkey and r = 1""",
    "merge_inner_documents_labels": "select cast(d.doc_id as varchar) as doc_id, lang, cast(quality as varchar) as quality, cast(toxic as varchar) as toxic from documents d join labels l on l.doc_id = d.doc_id",
    "reconcile_records": " union all ".join(f"""select '{c}' as "column", count(*) filter (x.{c} = y.{c}) as matches, count(*) filter (x.{c} <> y.{c}) as discrepancies from (select * from visits qualify row_number() over (partition by patient_id order by rid) = 1) x join (select * from visits where rid % 3 <> 0 qualify row_number() over (partition by patient_id order by rid) = 1) y using (patient_id)""" for c in ("birth_date", "age", "sex")),
    "repeated_key_consistency": " union all ".join(f"""select '{c}' as "column", count(*) as repeated_keys, count(*) filter (d > 1) as inconsistent from (select patient_id, count(distinct {c}) as d from visits group by 1 having count(*) > 1) t""" for c in ("birth_date", "age", "sex", "zip")),
    "crosswalk": "select cast(c_custkey as varchar) as id, case c_mktsegment when 'BUILDING' then '1' when 'MACHINERY' then '2' else c_mktsegment end as segment from customer",
    "validate_rules": f"""select 'error' as severity, 'minimum' as rule, 'age' as "column", rid as "row", age as "value" from intake where {num("age")} < 0
        union all select 'warning', 'maximum', 'age', rid, age from intake where {num("age")} > 120
        union all select 'error', 'ambiguous_date', 'admission_date', rid, admission_date from intake where admission_date = '03/04/2024'
        union all select 'error', 'duplicate_primary_key', 'participant_id', rid, participant_id from intake where rid >= 1000000000
        """
    + "".join(
        f""" union all select 'suggestion', 'iqr_outlier', '{c}', rid, {c} from intake, (select quantile_cont({num(c)}, 0.25) as q1, quantile_cont({num(c)}, 0.75) as q3 from intake where {free(c)}) q where {free(c)} and ({num(c)} < q1 - 1.5 * (q3 - q1) or {num(c)} > q3 + 1.5 * (q3 - q1))"""
        for c in ("age", "weight_kg", "cost_lab", "cost_drug", "cost_total", "poverty_score", "mother_age", "pulse_reading")
    )
    + "".join(
        f""" union all select 'suggestion', 'rare_value', '{c}', min(rid), trim({c}) from intake where trim({c}) <> '' group by trim({c}) having count(*) = 1
            and (select count(distinct trim({c})) from intake where trim({c}) <> '') between 2 and (select least(50, greatest(10, cast(floor(0.05 * count(*)) as int))) from intake) and not (select bool_or(regexp_matches({c}, '^0[0-9]+$')) from intake)"""
        for c in COLUMNS
        if c not in IDS
    ),
    "expectations_all": f"""select 0 as expectation, 'range' as type, 'age' as "column", count(*) filter (not {num("age")} between 0 and 120) as violations, 0 as not_evaluable, count(*) as evaluated from intake
        union all select 1, 'required', 'income', count(*) filter (income = ''), 0, count(*) from intake
        union all select 2, 'unique', 'participant_id', (select cast(sum(n) as bigint) from (select count(*) as n from intake group by participant_id having count(*) > 1) t), 0, count(*) from intake
        union all select 3, 'allowed_values', 'sex', count(*) filter (sex not in ('Female', 'Male')), 0, count(*) from intake
        union all select 4, 'conditional', 'has_spouse', count(*) filter (spouse_name <> ''), 0, count(*) from intake where has_spouse = 'No'""",
    "clean_fix_order": FIXED,
    "mutation_log": LOG,
    "plan_dry_run": f"""select "column", rule, count(*) as cells from ({LOG}) l group by 1, 2""",
    "safety_report": "select unnest(['row_count', 'columns', 'primary_keys', 'every_change_logged']) as \"check\", true as passed",
    "drop_duplicate_rows": "select participant_id, age from intake where rid < 1000000000",
    "profile_orders": "with o as (select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, " + typed("o_totalprice") + " as o_totalprice, cast(cast(o_orderdate as date) as varchar) as o_orderdate, o_orderpriority from orders) " + dictionary_sql(dict.fromkeys(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ""), "o", "(select count(*) from orders)"),
    "profile_dictionary": dictionary_sql({c: "id" if c in IDS else "" for c in COLUMNS}, "intake", "(select count(*) from intake)"),
    "profile_levels": " union all ".join(f"""(select '{c}' as "column", v as "value", n from (select trim({c}) as v, count(*) as n from intake where trim({c}) <> '' group by 1) t qualify row_number() over (order by n desc, v) <= 8)""" for c in ("sex", "grade", "region_name", "state")),
    "profile_quantiles": " union all ".join(f"""select '{c}' as "column", min({num(c)}) as low, quantile_cont({num(c)}, 0.25) as q1, quantile_cont({num(c)}, 0.5) as median, quantile_cont({num(c)}, 0.75) as q3, max({num(c)}) as high from intake where {free(c)}""" for c in NUMERIC),
    "primary_key_candidates": """select 'c_custkey' as "column" union all select 'c_name' union all select 'c_acctbal' from (select count(*) as n, count(distinct c_acctbal) as d from customer) t where n = d""",
    "freshness": f"""select c as "column", min(v) as earliest, max(v) as latest, count(*) as n, cast(date '{AS_OF}' - max(v)::date as int) as age_days from (select 'visit_date' as c, visit_date as v from intake union all select 'discharge_date', discharge_date from intake) t group by c""",
    "association_spearman": " union all ".join(map(ranked, [("cost_lab", "weight_kg"), ("cost_lab", "age"), ("weight_kg", "age")])),
    "association_eta_squared": " union all ".join(eta(m, g) for m in NUMERIC for g in GROUPS),
    "association_cramers_v": " union all ".join(cramer(a, b) for i, a in enumerate(GROUPS) for b in GROUPS[i + 1 :]),
    "trend_orders": "select 'o_totalprice' as measure, case when (select date_part('year', max(o_orderdate)) - date_part('year', min(o_orderdate)) from orders) >= 2 then strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%Y-%m') end as period, count(*) as n, round(avg(o_totalprice), 6) as mean from orders group by 1, 2",
    "trend_spearman_orders": " union all ".join(
        f"""select 'o_orderdate' as date, '{m}' as measure, count(*) as n, round(corr(rx, ry), 6) as rho, case when corr(rx, ry) > 0 then 'increasing' else 'decreasing' end as direction
        from (select rank() over (order by cast(o_orderdate as date)) + (count(*) over (partition by cast(o_orderdate as date)) - 1) / 2.0 as rx, rank() over (order by {m}) + (count(*) over (partition by {m}) - 1) / 2.0 as ry from orders where {m} not in (999, 9999, 777, 7777)) t"""
        for m in ("o_totalprice", "o_custkey")
    ),
    "concentration_totalprice": "select 'o_totalprice' as measure, max(n) as n, round(sum(o_totalprice) filter (r <= floor(n / 10)) / sum(o_totalprice), 6) as share from (select o_totalprice, row_number() over (order by o_totalprice desc) as r, count(*) over () as n from orders) t",
    "numeric_summaries": " union all ".join(f"""select '{c}' as measure, count(*) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd, round(avg(power((x - m) / s, 3)), 6) as skew, min(x) as low, quantile_cont(x, 0.5) as median, max(x) as high from (select {num(c)} as x, (select avg({num(c)}) from intake) as m, (select stddev_samp({num(c)}) from intake) as s from intake) t""" for c in NUMERIC),
    "dominant_values": """select 'batch' as "column", '' as "value", 0.0 as share where false union all """ + " union all ".join(f"""select '{c}' as "column", v as "value", round(n / t, 6) as share from (select trim({c}) as v, count(*) as n, sum(count(*)) over () as t, count(*) over () as k from intake where {c} <> '' group by 1) q where n >= 0.8 * t and k >= 2""" for c in ("sex", "grade", "level", "state", "region_name", "latitude", "body_temp", "has_spouse")),
    "standardized_ratio": """with t as (select grade = 'A' as mine, case when sex = 'Male' then 1 else 0 end as hit, sample_wt as s from intake), b as (select s, count(*) filter (mine) as n, coalesce(sum(hit) filter (mine), 0) as got, count(*) filter (not mine) as others, avg(hit) filter (not mine) as rate from t group by s)
        select cast(sum(got) filter (others >= 10) as bigint) as observed, round(sum(n * rate) filter (others >= 10), 6) as expected, round(sum(got) filter (others >= 10) / sum(n * rate) filter (others >= 10), 6) as ratio, round(sum(n) filter (others >= 10) / sum(n), 6) as coverage from b""",
    "determines": " union all ".join(f"""select '{g}' as "by", '{t}' as target, round(coalesce((sum(m) - max(top)) / nullif(sum(n) - max(top), 0), 0), 6) as lambda
        from (select max(n) as m, sum(n) as n from (select {g} as x, {t} as y, count(*) as n from intake group by 1, 2) j group by x) b, (select max(n) as top from (select count(*) as n from intake group by {t}) k) c""" for g, t in [("code_a", "code_b"), ("code_a", "grade"), ("grade", "code_a"), ("sex", "grade")]),
    "part_of_whole": " union all ".join(f"""select '{a}' as a, '{b}' as b, round(avg(case when {num(a)} <= {num(b)} then 1.0 else 0.0 end), 6) as share from intake where {free(a)} and {free(b)}""" for a, b in [("cost_lab", "cost_total"), ("cost_drug", "cost_lab")]),
    "within_strata_eta_squared": f"""with r as (select grade as s, code_a as g, {num("cost_lab")} as x from intake where {free("cost_lab")} and grade <> 'Z'), c as (select s, g, count(*) as n, sum(x) as sx, sum(x * x) as sxx from r group by 1, 2),
        e as (select s, sum(n) as n, sum(sx * sx / n) - sum(sx) * sum(sx) / sum(n) as b, sum(sxx) - sum(sx) * sum(sx) / sum(n) as t from c group by 1 having sum(n) >= 10) select 'cost_lab' as measure, 'code_a' as "by", cast(sum(n) as bigint) as n, round(sum(b) / sum(t), 6) as eta2 from e""",
    "blank_only_where": " union all ".join(f"""select '{c}' as "by", min(x) filter (gone) as low, max(x) filter (gone) as high from (select {num(c)} as x, spouse_name = '' as gone from intake where {free(c)}) t having count(x) filter (gone) >= 5 and count(x) filter (not gone) >= 5 and (max(x) filter (gone) < min(x) filter (not gone) or min(x) filter (gone) > max(x) filter (not gone))""" for c in NUMERIC),
    "coded_units": f"select rid, case when {num('zip')} between 10023 and 10352 then cast(cast(round_even(({num('zip')} - 10000) * 2.20462, 0) as int) as varchar) else zip end as pounds from intake",
    "quantile_bands": f"""with v as (select {num("cost_drug")} as x, row_number() over (order by {num("cost_drug")}) - 1 as r, count(*) over () as n from intake), c as (select {", ".join(f"max(x) filter (r = floor(n * {b} / 5)) as c{b}" for b in range(1, 5))} from v)
        select cast(x >= c1 as int) + cast(x >= c2 as int) + cast(x >= c3 as int) + cast(x >= c4 as int) as band, count(*) as n from v, c group by 1""",
}
WHOLE = {"within_strata_eta_squared", "standardized_ratio", "profile_orders", "quantile_bands"}


def complete(k: str, body: str) -> str:
    """The intake views before a body that may have its own."""
    return over("").rstrip() + ", " + body.removeprefix("with ") if k in WHOLE else over(body)


ORACLE_SQL = {k: complete(k, v) for k, v in SQL.items()}
