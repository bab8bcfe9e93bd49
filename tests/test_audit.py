"""Checks, repairs, tables, sources and streams: against DuckDB where SQL says the same, against planted cases elsewhere."""

import json
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.functions import exprs as X
from auditframe.functions import names as N
from auditframe.operators import CHECKS, cleaning, records, rules, tables
from auditframe.plans import more_queries, queries
from auditframe.plans.frame import AuditFrame, Bounds
from auditframe.plans.intake import intake
from auditframe.plans.investigation import Investigation
from auditframe.sources import readers, writers
from tests.oracle import assert_same, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL | more_queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same((queries.QUERIES | more_queries.QUERIES)[name](spark, sf_dir), (queries.ORACLE_SQL | more_queries.ORACLE_SQL)[name], sf_dir)


def one(spark, expr, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.select("i", expr(F.col("c")).alias("o")).orderBy("i").select("o").collect()]


def test_catalogue_is_complete():
    assert sorted(int(c.id[3:]) for c in CHECKS.values()) == list(range(1, 52))


def test_numbers(spark):
    values = ["1_000", " 5\t", "5 ", "1d", "0x1p3", "1e309", "nan", "inf", "+5", ".5", "5.", "-1.5E2", "", "__1", "1__0", "$5"]
    assert one(spark, X.number, values) == [1000.0, 5.0, 5.0, None, None, None, None, None, 5.0, 0.5, 5.0, -150.0, None, None, None, None]


def test_mojibake(spark):
    values = ["JosÃ©", "café", "plain", "Annâ€™s", "ï»¿x", "Ã", "李雷", "😀"]

    def by_python(v):
        try:
            fixed = v.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return None
        return fixed if fixed != v and not v.isascii() else None

    assert one(spark, X.mojibake_repair, values) == [by_python(v) for v in values]


def test_shapes(spark):
    assert one(spark, X.value_shape, ["555-123-4567", "(555) 123-4567", "john@example.com", "John Smith", "-7.25", "a--b", "é1 2"]) == ["D-D-D", "(D)SD-D", "L@L.L", "LSL", "#NUM#", "L-L", "LDSD"]


@pytest.mark.parametrize("fix,values,want", [
    (X.fix_whitespace, [" a  b\t", "a\tb", "ok"], ["a b", "a b", "ok"]),
    (X.fix_invisible, ["a​b", "Den ver", "ok"], ["ab", "Den ver", "ok"]),
    (X.fix_numeric_format, ["$1,200", "50k", "45%", "1.5M", "7", "x", "$0.50"], ["1200", "50000", "45%", "1500000", "7", "x", "0.5"]),
    (X.fix_excel_date, ["45000", "19999", "45000.5", "2023-01-01"], ["2023-03-15", "19999", "45000.5", "2023-01-01"]),
    (lambda c: X.fix_leading_zeros(c, 5), ["123", "12345", "a1"], ["00123", "12345", "a1"]),
    (lambda c: X.fix_date_iso(c, "%m/%d/%Y"), ["03/04/2024", "3-4-2024", "13/13/2020", "x"], ["2024-03-04", "2024-03-04", "13/13/2020", "x"]),
    (lambda c: X.fix_outliers(c, "cap", 0.0, 100.0, ["-99"]), ["-5", "150", "-99", "50", ""], ["0", "100", "-99", "50", ""]),
    (X.fix_pii_mask, ["call 555-123-4567", "123-45-6789", "a.b@c.org x"], ["call [phone]", "[SSN]", "[email] x"]),
])
def test_fixes_and_that_twice_is_once(spark, fix, values, want):
    assert one(spark, fix, values) == want
    assert one(spark, fix, want) == want


def test_names():
    assert N.is_id("patient_id") and N.is_id("county_fips") and not N.is_id("width") and N.is_pii("first_name") and not N.is_pii("county_name")
    assert N.ordered_pairs(["start_date", "end_date", "min_bp", "max_bp"]) == [("start_date", "end_date"), ("min_bp", "max_bp")]
    assert N.conditional_pairs(["has_spouse", "spouse_name", "is_flag"]) == [("has_spouse", "spouse_name")]
    assert N.profile_checks(["age", "zip", "sample_wt"]) == {"clinical_ranges", "zip_format", "survey_weights"}


def test_names_that_measure_the_same():
    assert N.related("total_personal_income", "wages_income") and N.related("visit_count", "clinic_visit_count")
    assert not N.related("blood_pressure", "blood_glucose") and not N.related("age", "income") and not N.related("status", "status_code")
    assert N.total_candidates(["total_income", "wage_income", "other_income", "age"]) == [("total_income", ["wage_income", "other_income"])]
    assert N.total_candidates(["total_personal_income", "personal_age", "wage_income", "other_income"]) == []
    assert N.total_candidates(["income_total", "total_income", "income_a", "income_b"]) == [("income_total", ["income_a", "income_b"]), ("total_income", ["income_a", "income_b"])]


def test_personal_names():
    personal = ["ssn", "MRN2", "dob", "email", "mail_address", "telephone", "phone_number", "surname", "name", "Patient_Name", "name_first", "birthdate", "date_of_birth", "social_security_number", "home_address", "addresses"]
    assert all(map(N.is_pii, personal))
    assert not any(map(N.is_pii, ["county_name", "site_name", "phones_owned", "weight", "namely", "address2", "nickel"]))


def test_label_clusters():
    got = records.similar_clusters({"Female": 9, "FEMALE": 1, " Male": 1, "Male": 8, "employed": 5, "unemployed": 5})
    assert {tuple(c["values"]): (c["canonical"], c["confidence"]) for c in got} == {("FEMALE", "Female"): ("Female", "high"), (" Male", "Male"): ("Male", "high")}
    assert records.synonym_clusters({"M": 3, "male": 2, "F": 4})[0]["canonical"] == "male"
    assert math.isclose(records.lcs_ratio("employed", "unemployed"), 88.888, abs_tol=1e-2)


def test_label_clusters_chain():
    """A cluster of doubled blanks is written as a value of another cluster: both are one, of the lower confidence."""
    got = records.similar_clusters({"aaaa  zzzzzzzz": 1, "AAAA  ZZZZZZZZ": 1, "x": 5})
    assert got == [{"values": ["AAAA  ZZZZZZZZ", "aaaa  zzzzzzzz"], "canonical": "AAAA ZZZZZZZZ", "confidence": "high"}]
    hidden = "\u200b"
    spelt, other = f"b{hidden * 9}", f"B{hidden * 9}"  # far from "b", but written as it
    chained = records.similar_clusters({spelt: 3, other: 1, "B": 2, "b": 7})
    assert chained == [{"values": sorted([spelt, other, "b", "B"]), "canonical": "b", "confidence": "high"}]
    medium = records.similar_clusters({spelt: 3, other: 1, "b": 7, "B": 2, "Northern": 4, "Norther": 1})
    assert {c["canonical"]: c["confidence"] for c in medium} == {"b": "high", "Northern": "medium"}
    near = f"Northern{hidden * 9}"
    both = records.similar_clusters({near: 3, near.upper(): 1, "Northern": 4, "Norther": 1})
    assert [(c["canonical"], c["confidence"], len(c["values"])) for c in both] == [("Northern", "medium", 4)]
    assert records.similar_clusters({str(i): 1 for i in range(51)}) == [] == records.similar_clusters({})


def test_label_clusters_by_trying_all_pairs():
    """Clusters against a walk over pairs, for labels without hidden characters."""
    rng = random.Random(4)
    for _ in range(60):
        counts = {"".join(rng.choice("abAB ") for _ in range(rng.randint(1, 6))) + rng.choice(["", "unit"]): rng.randint(1, 5) for _ in range(9)}
        counts = {k: n for k, n in counts.items() if k.strip()}
        clean = lambda v: " ".join(v.split())
        near = {v: {w for w in counts if v.strip().casefold() == w.strip().casefold() or records.lcs_ratio(v.strip().casefold(), w.strip().casefold()) >= 85 and not records.is_negation(v.strip().casefold(), w.strip().casefold())} for v in counts}
        seen, want = set(), []
        for v in counts:
            if v not in seen:
                todo, group = [v], set()
                while todo:
                    x = todo.pop()
                    if x not in group:
                        group.add(x)
                        todo += near[x]
                seen |= group
                want += [group] if len(group) > 1 else []
        got = records.similar_clusters(counts)
        assert sorted(x for c in got for x in c["values"]) == sorted(x for c in want for x in c)
        for c in got:
            inside = [g for g in want if g & set(c["values"])]
            assert set().union(*inside) == set(c["values"]) and c["canonical"] == clean(c["canonical"])
            assert (c["confidence"] == "high") == all(len({x.strip().casefold() for x in g}) == 1 for g in inside)


def test_names_nearly_the_same(spark):
    """Fuzzy duplicates against every pair of a block."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(60):
        name = f"{letters(7)} {letters(8)}"
        for _ in range(3):
            spelt = list(name)
            if rng.random() < 0.6:
                spelt[rng.randrange(len(spelt))] = rng.choice("xyz")
            rows.append((len(rows), f"p{rng.randint(0, 500)}", " ".join(reversed("".join(spelt).split())) if rng.random() < 0.3 else "".join(spelt), f"19{50 + i % 9}-01-01"))
    f = AuditFrame(spark.createDataFrame(rows, "_rid long, patient_id string, full_name string, birth_date string"))

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return 200 * best[-1][-1] / (len(a) + len(b))

    sort = lambda v: " ".join(sorted(v.split()))
    want = {(b[0], str(a[0])) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and a[1] != b[1] and a[2] != b[2] and common(sort(a[2]), sort(b[2])) >= 90}
    got = CHECKS["fuzzy_duplicate_entities"].run(f)
    assert {(r.row, r.detail) for r in got.collect()} == want and want


def test_clean_again_changes_nothing_and_log_explains_all(spark, sf_dir):
    f = intake(spark, sf_dir)
    case = Investigation(f)
    proposed, fixes = case.propose()
    assert not set(f.primary_key) & {c for by in fixes.values() for c in by}
    rows, log, safety = case.clean(proposed, fixes, drop_duplicates=False)
    assert all(r.passed for r in safety.collect()) and log.count() > 0
    after = AuditFrame(rows, as_of=f.as_of, primary_key=f.primary_key)
    assert cleaning.clean(after, proposed, fixes)[1].count() == 0
    left = Investigation(after)
    for key in ("whitespace", "invisible_characters", "encoding_corruption", "synonym_codes", "mixed_units"):
        assert case.count(key) and not left.count(key), key
    assert case.sample("invisible_characters")[0]["value"] == cleaning.HIDDEN
    page = writers.render_html("<Audit>", {"mixed_units": case.sample("mixed_units")})
    assert "&lt;Audit&gt;" in page and "kg lb" in page


def test_not_applicable_is_not_passed(spark):
    f = AuditFrame(spark.createDataFrame([(0, "x"), (1, "y")], "_rid long, label string"))
    assert CHECKS["fips_format"].run(f) is None and CHECKS["whitespace"].run(f).count() == 0
    empty = AuditFrame(spark.createDataFrame([], "_rid long, age string, label string"))
    for c in CHECKS.values():
        got = c.run(empty)
        assert got is None or got.count() == 0, c.key


def test_expectations_refuse_what_is_wrong(spark):
    f = AuditFrame(spark.createDataFrame([(0, "1")], "_rid long, a string"))
    for spec in ({"type": "odd", "column": "a"}, {"type": "range", "column": "a"}, {"type": "required", "column": "b"}):
        with pytest.raises(ValueError):
            rules.evaluate_expectations(f, [spec])
    with pytest.raises(ValueError):
        cleaning.clean(f, {"category_mappings": {"a": {"x": "y", "y": "z"}}})
    assert rules.chained_keys({"a": "b", "b": "c", "d": "d"}) == ["b"]


def test_delimited(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("﻿id;name;note\n1;Ann;x\n\n2;\"B;c\";y;extra;more\n3;short\nTotal\nSource: us\n".encode())
    rows = [r.asDict() for r in readers.read_delimited(spark, str(p)).orderBy("_rid").collect()]
    # the ragged lines 2 and 3 are a pair, and so is what follows: no good line comes after the first pair
    assert [(r["id"], r["name"], r["note"], r["_overflow"]) for r in rows] == [("1", "Ann", "x", "")]
    assert readers.delimiter_of(["a\tb", "c\td"]) == "\t" and readers.deduplicate_header(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert readers.split_line(readers.join_line(["a,b", 'c"d', ""]), ",") == ["a,b", 'c"d', ""]
    (tmp_path / "dup.csv").write_text("a,a\n1,2\n")
    with pytest.raises(readers.IngestError):
        readers.read_table(spark, str(tmp_path / "dup.csv"))
    (tmp_path / "latin.csv").write_bytes("nom,ville\nRené,Orléans\nZoé,Genève\n".encode("latin-1"))
    assert {r.nom for r in readers.read_delimited(spark, str(tmp_path / "latin.csv"), encoding="latin-1").collect()} == {"René", "Zoé"}


@pytest.mark.parametrize("shape,kept", [
    ("ggg", 3), ("gggbb", 3), ("gbgbb", 3), ("gbbgbb", 6), ("gbbgb", 5), ("gggb", 4), ("bb", 0), ("b", 1), ("gb gb b", 3), ("gb b gbb", 6), ("", 0),
])
def test_footers(spark, tmp_path, shape, kept):
    """Good and bad lines, blank ones between: a footer is the first pair of bad ones if no good one follows."""
    (tmp_path / "f.csv").write_text("a,b\n" + "".join({"g": f"{i},x\n", "b": f"total {i}\n", " ": "\n"}[c] for i, c in enumerate(shape)))
    assert readers.read_delimited(spark, str(tmp_path / "f.csv")).count() == kept
    assert readers.read_delimited(spark, str(tmp_path / "f.csv"), keep_footer=True).count() == len(shape.replace(" ", ""))
    assert readers.stripped_footer_lines(spark, str(tmp_path / "f.csv")) == len(shape.replace(" ", "")) - kept


def test_footer_pairs_across_ranges(spark):
    rows = spark.createDataFrame([(i, ["x"] * (1 if i in (4, 5) else 2)) for i in range(1, 12)], "line long, fields array<string>")
    odd = rows.selectExpr("line", "size(fields) = 2 as fits")
    assert readers.pair_before(odd, 11, span=5) and readers.pair_before(odd, 11, span=100) and not readers.pair_before(odd.where("line <> 4"), 11, span=5)


def test_json_codebook_parquet(spark, tmp_path, sf_dir):
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1, "b": True}, {"c": None, "a": 2.0}]))
    got = readers.read_table(spark, str(tmp_path / "t.json")).orderBy("_rid").collect()
    assert [tuple(r) for r in got] == [(0, "1", "true", ""), (1, "2", "", "")]
    (tmp_path / "n.json").write_text(json.dumps([{"a": [1]}]))
    with pytest.raises(readers.IngestError):
        readers.read_table(spark, str(tmp_path / "n.json"))
    assert readers.read_codebook(b"Variable,Value,Label\nsex,1,Male\nsex,9,Refused\n") == {"sex": {"1": "Male", "9": "Refused"}}
    with pytest.raises(readers.IngestError):
        readers.read_codebook(b"column,code,label\na,1,x\na,1,y\n")
    n = readers.read_table(spark, f"{sf_dir}/nation.parquet")
    assert sorted(r._rid for r in n.collect()) == list(range(25))


def test_write(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([(1, "b"), (0, "a")], "_rid long, x string"), str(tmp_path / "out"))
    assert {r.x for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {"a", "b"}
    writers.atomic_write(str(tmp_path / "m.json"), "{}")
    m = writers.manifest([str(tmp_path / "m.json")], mutations=3)
    assert m["run_id"] == writers.manifest([str(tmp_path / "m.json")], mutations=3)["run_id"] and "| a |" in writers.render_markdown("t", {"s": [{"a": "x|y"}]})


def test_stream(spark, tmp_path):
    from auditframe.streaming import rows as S

    spark.createDataFrame([(1, " padded "), (2, "JosÃ©"), (3, "fine")], "k long, c string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, c string").parquet(str(tmp_path / "in"))
    for name, frame in (("flags", S.flagged(stream, ["k"])), ("fixed", S.cleaned(stream, {}, {"mojibake": ["c"], "whitespace": ["c"]}))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert {(int(r.k), r.check) for r in spark.table("flags").collect()} == {(1, "whitespace"), (2, "encoding_corruption")}
    assert {r.c for r in spark.table("fixed").collect()} == {"padded", "José", "fine"}


def test_merge_keeps_children(spark):
    a = AuditFrame(spark.createDataFrame([(0, "1", "x"), (1, "1", "y"), (2, "2", "z")], "_rid long, id string, v string"))
    b = AuditFrame(spark.createDataFrame([(0, " 1 ", "p"), (1, "3", "q"), (2, "", "r")], "_rid long, fk string, v string"))
    left = {r["fk"]: (r["v (a)"], r["v (b)"]) for r in tables.merge(a, "id", b, "fk").collect()}
    assert left == {" 1 ": ("x", "p"), "3": (None, "q"), "": (None, "r")}
    assert tables.merge(a, "id", b, "fk", how="inner").count() == 1


def test_planted_errors_are_found(spark):
    from auditframe.plans import injection

    got, (clean, spoilt, repaired) = injection.run(spark, 1000, 0)
    assert clean == 100 and spoilt < clean and repaired >= spoilt
    assert {"inconsistent_categories", "mixed_units", "group_missingness"} <= {r["check"] for r in got}
    for r in got:
        assert r["planted"] == r["caught"] and r["clean"] == 0, r
    for r in got:
        if r["check"] in ("whitespace", "invisible_characters", "encoding_corruption", "numeric_representation", "missing_value_codes", "duplicate_rows"):
            assert r["left"] == 0, r


def test_insights(spark, sf_dir):
    from auditframe.operators import insights as I

    f = intake(spark, sf_dir)
    assert I.effect_verdict(0.5, 0.1, 0.3) == "explained" and I.effect_verdict(0.5, 0.2, 0.1) == "partly" and I.effect_verdict(0.5, 0.4, 0.3) == "holds" and I.effect_verdict(0, 0, 0.3) == "holds"
    assert I.ratio_verdict(2.0, 1.1) == "explained" and I.ratio_verdict(4.0, 2.0) == "partly" and I.ratio_verdict(2.0, 1.9) == "holds"
    assert {r["lambda"] for r in I.determines(f, [("code_a", "code_b"), ("code_b", "code_a")]).collect()} == {1.0}
    assert I.part_of_whole(f, [("cost_lab", "cost_total")]).first().share >= 0.98
    assert 0 <= I.within_strata_eta_squared(f, "cost_lab", "grade", "sex").first().eta2 <= 1
    assert -1 <= I.within_strata_spearman(f, "cost_lab", "cost_drug", "weight_kg").first().rho <= 1
    assert all(r.epsilon2 >= 0 for r in I.epsilon_squared(f, ["grade"], ["cost_lab"]).collect())
    chosen = I.select_cards([{"kind": "a", "columns": (str(i),), "score": i / 20, "text": ""} for i in range(9)] + [{"kind": str(i), "columns": ("x",), "score": 1.0, "text": ""} for i in range(5)])
    assert len(chosen) == 6 and chosen[0]["score"] == 1.0
    assert I.key_insights(f).count() > 0
    assert not I.looks_like_codes(f, "cost_lab") and I.looks_like_codes(f, "sample_wt")
    assert I.impute_value(f, "sex") in ("Female", "Male")


def test_coded_units(spark):
    from auditframe.operators import insights as I

    specs = I.coded_ranges({"weight_lbs": {"9023-9352": "Weight in kilograms (value minus 9000)", "7777": "Don't know"}, "height_ft_in": {"9061-9998": "Height in centimeters (value minus 9000)"}})
    assert specs["weight_lbs"] == (9023.0, 9352.0, 9000.0, "kg")
    assert one(spark, lambda c: I.fix_coded_units(c, "weight_lbs", specs["weight_lbs"]), ["9080", "180", "7777"]) == ["176", "180", "7777"]
    assert one(spark, lambda c: I.fix_coded_units(c, "height_ft_in", specs["height_ft_in"]), ["9180", "511"]) == ["511", "511"]


def test_every_rare_stratum_is_pooled(spark):
    """1,500 levels on a row each, and one on 20: two strata."""
    from auditframe.operators import insights as I

    rows = [(i, f"rare{i}" if i < 1500 else "common", "ab"[i % 2], str(i % 7)) for i in range(1520)]
    f = AuditFrame(spark.createDataFrame(rows, "_rid long, level string, side string, x string"))
    assert {r["__s"]: r["count"] for r in I.stratified(f, "level").groupBy("__s").count().collect()} == {"other": 1500, "common": 20}
    assert I.within_strata_eta_squared(f, "x", "side", "level").first().n == 1520


@pytest.mark.parametrize("values", [[5], [1, 2], [3] * 9, [math.pi * i % 7 for i in range(999)], [1e300, -1e300, 0.0, 2.5], [i // 100 for i in range(1000)]])
def test_quantiles_are_exact(spark, values):
    from auditframe.operators.ordered import quantiles, running

    rows = spark.createDataFrame([(k, float(v) + k) for k in (0, 1) for v in values] + [(0, None)], "k int, x double").groupBy("k", "x").agg(F.count("*").alias("n"))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in quantiles(rows, ["k"], shares).collect()}
    for k in (0, 1):
        assert got[k].total == len(values) and got[k].q == pytest.approx(np.quantile([v + k for v in values], shares).tolist())
    upto = {(r.k, r.x): (r.upto, r.below) for r in running(rows, ["k"]).collect()}
    mine = sorted(float(v) for v in values)
    assert all(upto[0, x] == (sum(y <= x for y in mine), max((y for y in mine if y < x), default=None)) for x in set(mine))


LARGE = ["df32_group_missingness", "df49_rare_combinations", "association_eta_squared", "association_cramers_v", "association_spearman", "standardized_ratio", "determines", "within_strata_eta_squared"]


@pytest.fixture(scope="module")
def large_dir(spark, tmp_path_factory):
    """Over 20,000 rows, where bounds would bite."""
    path = str(tmp_path_factory.mktemp("large"))
    spark.range(1, 23_001).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{path}/customer.parquet")
    return path


@pytest.mark.parametrize("name", LARGE)
def test_all_rows_are_read(spark, large_dir, name):
    cur = duckdb.connect()
    cur.execute(f"create view customer as select * from '{large_dir}/customer.parquet/*.parquet'")
    sql = (queries.ORACLE_SQL | more_queries.ORACLE_SQL)[name]
    got, want = (queries.QUERIES | more_queries.QUERIES)[name](spark, large_dir), cur.execute(sql)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())


def test_bounds_sample_evenly(spark):
    from auditframe.operators.columns import sampled

    df = spark.range(1000).selectExpr("id * 3 as _rid", "cast(id as string) as a").repartition(5)
    assert sampled(AuditFrame(df)).count() == 1000
    some = sampled(AuditFrame(df, bounds=Bounds(rows=100)))
    assert sorted(r._rid for r in some.collect()) == [i * 30 for i in range(100)]


def test_rules_are_checked_whole():
    rules.check_rules({"columns": {"a": {"type": "date", "minimum": 1}}, "missing_values": {"a": {"-9": ""}}, "category_mappings": {"a": {"x": "y"}}}, ["a"])
    for bad in ([], {"odd": 1}, {"columns": []}, {"columns": {"a": {"max": 3}}}, {"columns": {"a": {"minimum": "1"}}}, {"columns": {"a": {"minimum": 3, "maximum": 1}}}, {"columns": {"b": {}}},
                {"missing_values": {"a": {"-9": "x"}}, "category_mappings": {"a": {"x": "y"}}}, {"category_mappings": {"a": {"x": 1}}}, {"expectations": [{"type": "odd", "column": "a"}]}):
        with pytest.raises(ValueError):
            rules.check_rules(bad, ["a"])
    assert rules.mapping_conflicts({"-9": ""}, {"-9": "x", "y": "z"}) == ["-9"] and rules.mapping_conflicts({"-9": "u"}, {"u": "v"}) == ["u"] and rules.mapping_conflicts({"-9": ""}, {"x": "y"}) == []
    assert rules.describe({"type": "range", "column": "a", "min": 0}) == "a is ≥ 0" and rules.describe({"type": "range", "column": "a", "min": 0, "max": 2}) == "a is between 0 and 2"
    assert rules.describe({"type": "conditional", "when": {"column": "a", "op": "=", "value": "x"}, "then": {"column": "b", "op": "is blank"}}) == "if a = x then b is blank"


def test_safety_sees_a_wrong_log(spark):
    f = AuditFrame(spark.createDataFrame([(0, " x "), (1, "y")], "_rid long, label string"))
    rows, log = cleaning.clean(f, {}, {"whitespace": ["label"]})
    passed = lambda other: {r.check: r.passed for r in cleaning.safety_report(f, rows, other).collect()}["every_change_logged"]
    assert passed(log) and not passed(log.withColumn("new_value", F.lit("z"))) and not passed(log.limit(0))


def test_suggested_keys_and_fills(spark):
    from auditframe.operators.insights import is_fill_candidate
    from auditframe.plans.profile import suggest_primary_key

    rows = [(i, f"h{i // 3}", str(i % 3), "z", "" if i % 2 else "a", f"note {i}") for i in range(12)]
    f = AuditFrame(spark.createDataFrame(rows, "_rid long, household_id string, person_number string, zip string, mood string, note string"))
    assert suggest_primary_key(f) == ["household_id", "person_number"] and is_fill_candidate(f, "mood") and not is_fill_candidate(f, "note")
    assert suggest_primary_key(AuditFrame(f.wide.withColumn("record_id", F.col("note")))) == ["record_id"]
    assert suggest_primary_key(AuditFrame(f.wide.select("_rid", "zip", "mood"))) == ["mood"]


def test_harmonize_writes_all_or_nothing(spark, tmp_path, capsys):
    from auditframe import cli

    (tmp_path / "a.csv").write_text("id,sex\n1, F\n2,M\n3,F\n")
    (tmp_path / "b.csv").write_text("pid,gender\n1,f\n2,m\n3,f\n")
    (tmp_path / "a.yaml").write_text("version: 1\nprimary_key: [id]\nsafe_fixes: {whitespace: [sex]}\n")
    files, out, cross = [str(tmp_path / x) for x in ("a.csv", "b.csv")], tmp_path / "out", tmp_path / "cross.yaml"
    said = {"a.csv": {"rules": str(tmp_path / "a.yaml")}, "b.csv": {"column_map": {"pid": "id", "gender": "sex"}, "value_map": {"gender": {"f": "F", "m": "M"}}}}

    def call(said, *more):
        cross.write_text(json.dumps(said))
        return cli.main(["harmonize", *files, "--crosswalk", str(cross), "--out", str(out), *more])

    assert call(said) == 0 and not out.exists()
    assert call(said | {"b.csv": {"column_map": {"nowhere": "id"}}}, "--execute") == 2 and not out.exists()
    assert call(said | {"b.csv": {"column_map": {"pid": "gender"}}}, "--execute") == 2 and not out.exists()
    assert call({"a.csv": {}}, "--execute") == 2 and not out.exists()
    assert call(said, "--execute") == 0
    for name in ("a.csv", "b.csv"):
        assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(out / name / "rows")).collect()) == [("1", "F"), ("2", "M"), ("3", "F")]
    assert json.loads((out / "a.csv" / "manifest.json").read_text())["mutations"] == 1


def test_columns_that_count_rows(spark):
    """The counter only rises and says nothing; the sorted ages repeat and do; the span doesn't matter."""
    from auditframe.operators import insights as I

    rows = [(i, "" if i >= 40 else "x", str(i * 2), str(20 + i // 4), str((i * 37) % 101), str(-i)) for i in range(50)]
    f = AuditFrame(spark.createDataFrame(rows, "_rid long, filled string, counter string, age string, mixed string, falls string"))
    for span in (1 << 20, 7, 1):
        assert I.monotone(f, ["counter", "age", "mixed", "falls"], span) == {"counter", "age", "falls"}
    assert [r.by for r in I.blank_only_where(f, "filled", ["counter", "age", "falls"]).collect()] == ["age"]


def test_unions_and_sizes(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([("y", 2)], "w string, id int")
    got = writers.stacked([a, b])
    assert got.columns == writers.column_union([a, b]) == ["id", "v", "w"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", None), (2, None, "y")]
    assert [writers.format_bytes(n) for n in (0, 1023, 1024, 1536, 1 << 20, 1 << 31)] == ["0 bytes", "1023 bytes", "1.0 KB", "1.5 KB", "1.0 MB", "2048.0 MB"]


def test_digits_inside_a_text_are_no_placeholder(spark, tmp_path):
    texts = ["note a entry 11111", "note b entry 22", "aaaaaaa", "so yeeeees", "-----", "77777", "٣٣٣٣٣", "call 5555555555", "a note"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_rid long, remark string")
    found = CHECKS["placeholder_text"].run(AuditFrame(rows)).collect()
    assert sorted(r.row for r in found) == [2, 3, 4, 5, 6]
    name = "df50_placeholder_text"  # keys as they are in larger tables
    spark.range(11000, 11400).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    assert_same(queries.QUERIES[name](spark, str(tmp_path)), queries.ORACLE_SQL[name], str(tmp_path))


def test_catalogue_counts_cells_in_two_passes(spark, sf_dir):
    f = intake(spark, sf_dir)
    odd = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate([(" -5 ", "a"), ("", "b"), ("nan", " c"), ("1e309", ""), ("\u2003", "\u2003x"), ("130", "11111"), (None, None), ("a,  b", "JosÃ©")] * 3)], "_rid long, age string, note string")
    for frame in (f, AuditFrame(odd, as_of="2026-01-01")):
        found = {k: c.run(frame) for k, c in CHECKS.items()}
        cells = {k: e for k, e in found.items() if e is not None and e in frame.conditions}
        spark.sparkContext.setJobGroup("counts", "counts")
        got = frame.counts(cells)
        spark.sparkContext.setJobGroup("other", "other")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counts")) < len(cells)  # a job a check or more before
        assert got == {k: e.count() for k, e in cells.items()}
        assert frame.counts({"none": None, "listed": frame.listed([("a", None, None)])}) == {"none": None, "listed": 1}
    assert len(cells) >= 5 and any(got.values())


def test_white_space_is_that_of_unicode(spark):
    chars = [chr(i) for i in range(0x3100)]
    blank = [c for c in chars if re.fullmatch(r"\s", c)]  # Python's has \x1c to \x1f too
    assert one(spark, X.strip, [f"{c}a{c} b{c}{c}" for c in chars]) == [f"a{c} b" if c in blank else f"{c}a{c} b{c}{c}" for c in chars]
