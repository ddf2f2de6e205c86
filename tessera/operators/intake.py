"""Intake submissions: JSON payloads of sections, value checks, clean values, gaps and the canonical state.

Payloads are VARIANT columns. All rules work within a row, so nothing here shuffles. A number is a JSON number
or a string that is wholly one; a date is YYYY-MM-DD; nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plausible ranges, lists of named items, sections of the canonical state, severities of gaps.
RANGES = {"height_cm": (50.0, 260.0), "weight_kg": (2.0, 400.0), "waist_cm": (20.0, 250.0)}
NAMED = {
    ("MEDICATIONS", "medications"): ("name", "medication"),
    ("MEDICATIONS", "supplements"): ("name", "supplement"),
    ("DIAGNOSES_HISTORY", "known_diagnoses"): ("condition", "diagnosis"),
    ("SYMPTOMS", "current_symptoms"): ("symptom", "symptom"),
}
SECTIONS = "BASIC_PROFILE GOALS DIAGNOSES_HISTORY MEDICATIONS LABS_REPORTS SYMPTOMS DIET_PATTERN FOOD_ENVIRONMENT HYDRATION_MOVEMENT DIGESTIVE REPRODUCTIVE PREVIOUS_ATTEMPTS FOOD_LOG".split()
SEVERITIES = ("CRITICAL", "HIGH", "MODERATE", "LOW")
DROPPED, UNKNOWN_VALUE, UNKNOWN = "DROPPED", "TREATED_AS_UNKNOWN", "UNKNOWN"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ISSUE = "array<struct<field_path:string,problem:string,action:string>>"


def parse_payload(df: DataFrame, column: str = "raw_payload", out: str = "p") -> DataFrame:
    """df with the payload as VARIANT; what isn't JSON, and null, is null."""
    return df.withColumn(out, F.try_parse_json(column))


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def given(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) != "VOID", F.lit(False))


def as_text(v: Column) -> Column:
    """The trimmed text of a string, number or truth value; empty for what is absent."""
    return F.btrim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def as_number(v: Column) -> Column:
    text = as_text(v)
    plain = ~F.coalesce(F.schema_of_variant(v).rlike("^(BOOLEAN|OBJECT|ARRAY)"), F.lit(False))
    return F.when(plain & text.rlike(NUMBER), text.try_cast("double"))


def as_date(v: Column) -> Column:
    text = as_text(v)
    return F.when(is_text(v) & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def items(p: Column, section: str, key: str) -> Column:
    return F.coalesce(at(p, f"$.sections.{section}.{key}", "array<variant>"), F.expr("cast(array() AS array<variant>)"))


def _issue(path: Column, problem: Column, action) -> Column:
    action = F.lit(action) if isinstance(action, str) else action
    return F.struct(path.alias("field_path"), problem.alias("problem"), action.alias("action"))


def _each(column: Column, prefix: str, rule, suffix: str = "", action: str = DROPPED) -> Column:
    """An issue for each item for which rule gives a problem."""
    made = F.transform(column, lambda x, i: _issue(F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit(f"]{suffix}")), rule(x), action))
    return F.filter(made, lambda s: s["problem"].isNotNull())


def _one(path: str, problem: Column, action: str = UNKNOWN_VALUE) -> Column:
    return F.filter(F.array(_issue(F.lit(path), problem, action)), lambda s: s["problem"].isNotNull())


def _lab_problem(x: Column) -> Column:
    value = at(x, "$.value")
    return F.when(~is_object(x), "not an object").when(as_text(at(x, "$.marker")) == "", "no marker").when(given(value) & as_number(value).isNull(), "value is not a number")


def _lab_date(x: Column, panel: Column) -> Column:
    own = at(x, "$.date")
    return F.when(given(own), as_date(own)).otherwise(panel)


def _severity_ok(x: Column) -> Column:
    return F.coalesce(as_number(at(x, "$.severity")).between(0, 10), F.lit(False))


def value_issues(p: Column, sections: list[str], statuses: list[str]) -> Column:
    """The issues of one payload, as an array; sections and statuses are small registries."""
    parts = [_one("sections", F.when(given(at(p, "$.sections")) & ~is_object(at(p, "$.sections")), "not an object"))]
    entries = F.map_entries(F.coalesce(at(p, "$.sections", "map<string,variant>"), F.expr("cast(map() AS map<string,variant>)")))

    def of_section(e):
        known = e["key"].isin(*sections)
        problem = F.when(~known, "unknown section").when(~is_object(e["value"]), "section is not an object")
        return _issue(F.concat(F.lit("sections."), e["key"]), problem, F.when(known, UNKNOWN_VALUE).otherwise(DROPPED))

    parts.append(F.filter(F.transform(entries, of_section), lambda s: s["problem"].isNotNull()))
    for key, (low, high) in RANGES.items():
        v = at(p, f"$.sections.BASIC_PROFILE.{key}")
        n = as_number(v)
        parts.append(_one(f"BASIC_PROFILE.{key}", F.when(given(v) & n.isNull(), "not a number").when(~n.between(low, high), f"outside {low} to {high}")))
    for path, v in (("measured_on", at(p, "$.measured_on")), ("LABS_REPORTS.lab_dates", at(p, "$.sections.LABS_REPORTS.lab_dates"))):
        parts.append(_one(path, F.when(given(v) & as_date(v).isNull(), "not an ISO date")))
    labs, prefix = items(p, "LABS_REPORTS", "lab_values"), "LABS_REPORTS.lab_values"
    parts.append(_each(labs, prefix, _lab_problem))
    for bound in ("ref_low", "ref_high"):
        parts.append(_each(labs, prefix, lambda x, b=bound: F.when(_lab_problem(x).isNull() & given(at(x, f"$.{b}")) & as_number(at(x, f"$.{b}")).isNull(), "not a number"), f".{bound}", UNKNOWN_VALUE))
    panel = as_date(at(p, "$.sections.LABS_REPORTS.lab_dates"))
    parts.append(_each(labs, prefix, lambda x: F.when(_lab_problem(x).isNull() & _lab_date(x, panel).isNull(), "no usable date"), ".date"))
    reports = items(p, "LABS_REPORTS", "lab_reports")
    parts.append(_each(reports, "LABS_REPORTS.lab_reports", lambda x: F.when(~is_object(x), "not an object")))
    parts.append(_each(reports, "LABS_REPORTS.lab_reports", lambda x: F.when(is_object(x) & given(at(x, "$.date")) & as_date(at(x, "$.date")).isNull(), "not an ISO date"), ".date", UNKNOWN_VALUE))
    for (section, key), (name, noun) in NAMED.items():
        rows = items(p, section, key)
        parts.append(_each(rows, f"{section}.{key}", lambda x, n=noun: F.when(is_text(x) & (as_text(x) == ""), f"an empty {n}").when(~is_text(x) & ~is_object(x), f"a {n} is a name or an object")))
        parts.append(_each(rows, f"{section}.{key}", lambda x, k=name, n=noun: F.when(is_object(x) & (as_text(at(x, f"$.{k}")) == ""), f"a {n} without a name"), f".{name}"))
        if name in ("condition", "symptom"):
            parts.append(_each(rows, f"{section}.{key}", lambda x, k=name: F.when(is_object(x) & (as_text(at(x, f"$.{k}")) != "") & given(at(x, "$.severity")) & ~_severity_ok(x), "severity is not 0 to 10"), ".severity", UNKNOWN_VALUE))
    days = items(p, "FOOD_LOG", "food_log_days")
    parts.append(_each(days, "FOOD_LOG.food_log_days", lambda x: F.when(~is_object(x), "not an object")))
    parts.append(_each(days, "FOOD_LOG.food_log_days", lambda x: F.when(is_object(x) & as_date(at(x, "$.date")).isNull(), "no usable date"), ".date"))
    rht = at(p, "$.sections.RHT_LINKAGE.rht_status")
    parts.append(_one("RHT_LINKAGE.rht_status", F.when(given(rht) & ~F.upper(as_text(rht)).isin(*statuses), "unknown status")))
    return F.concat(*[x.cast(ISSUE) for x in parts])


def check_values(submissions: DataFrame, sections: list[str], statuses: list[str], column: str = "raw_payload", key: str = "submission_id") -> DataFrame:
    """(key, field_path, problem, action) for values that were given and can't be used. What is missing is no issue."""
    rows = parse_payload(submissions.select(key, column), column)
    return rows.select(key, F.explode(value_issues(F.col("p"), sections, statuses)).alias("i")).select(key, "i.*")


def _is_named(name: str):
    return lambda x: F.when(is_text(x), as_text(x) != "").otherwise(is_object(x) & (as_text(at(x, f"$.{name}")) != ""))


def _named_fields(name: str):
    """Of a named item: for medicines their use, UNKNOWN where it isn't given; for the others the severity."""

    def fields(x):
        title = F.when(is_text(x), as_text(x)).otherwise(as_text(at(x, f"$.{name}"))).alias(name)
        if name == "name":
            return F.struct(title, *[F.coalesce(F.nullif(as_text(at(x, f"$.{c}")), F.lit("")), F.lit(UNKNOWN)).alias(c) for c in ("dose", "timing", "reason")])
        return F.struct(title, F.when(_severity_ok(x), as_number(at(x, "$.severity")).cast("int")).alias("severity"))

    return fields


def sanitize(submissions: DataFrame, statuses: list[str], column: str = "raw_payload") -> DataFrame:
    """submissions with the usable values as typed columns: measures, measured_on, lists of structs, rht_status.

    Unusable values are left out, none is replaced by a default. A lab value without a date of its own takes
    the panel's; one whose own date can't be read is left out.
    """
    df = parse_payload(submissions, column)
    p = F.col("p")
    out = {"measured_on": as_date(at(p, "$.measured_on"))}
    for key, (low, high) in RANGES.items():
        n = as_number(at(p, f"$.sections.BASIC_PROFILE.{key}"))
        out[key] = F.when(n.between(low, high), n)
    panel = as_date(at(p, "$.sections.LABS_REPORTS.lab_dates"))
    labs = F.filter(items(p, "LABS_REPORTS", "lab_values"), lambda x: _lab_problem(x).isNull() & _lab_date(x, panel).isNotNull())
    out["labs"] = F.transform(
        labs,
        lambda x: F.struct(
            as_text(at(x, "$.marker")).alias("marker"), as_number(at(x, "$.value")).alias("value"), at(x, "$.unit", "string").alias("unit"), as_number(at(x, "$.ref_low")).alias("ref_low"),
            as_number(at(x, "$.ref_high")).alias("ref_high"), _lab_date(x, panel).alias("date"), at(x, "$.report_ref", "string").alias("report_ref"),
        ),
    )
    out["reports"] = F.transform(
        F.filter(items(p, "LABS_REPORTS", "lab_reports"), is_object),
        lambda x: F.struct(F.coalesce(at(x, "$.ref", "string"), at(x, "$.filename", "string")).alias("ref"), F.coalesce(at(x, "$.kind", "string"), F.lit("LAB_PANEL")).alias("kind"), as_date(at(x, "$.date")).alias("date"), at(x, "$.laboratory", "string").alias("laboratory")),
    )
    for (section, key), (name, _) in NAMED.items():
        out[key] = F.transform(F.filter(items(p, section, key), _is_named(name)), _named_fields(name))
    days = F.filter(items(p, "FOOD_LOG", "food_log_days"), lambda x: is_object(x) & as_date(at(x, "$.date")).isNotNull())
    out["food_log_days"] = F.transform(days, lambda x: F.struct(as_date(at(x, "$.date")).alias("date"), at(x, "$.raw_text", "string").alias("raw_text")))
    rht = at(p, "$.sections.RHT_LINKAGE.rht_status")
    out["rht_status"] = F.when(given(rht), F.when(F.upper(as_text(rht)).isin(*statuses), F.upper(as_text(rht))).otherwise("NOT_ASSESSED"))
    return df.withColumns(out)


def extract(clean: DataFrame, key: str = "client_id") -> dict[str, DataFrame]:
    """The rows of each kind of fact from sanitize()."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.lit(m.rsplit("_", 1)[1]).alias("unit")) for m in RANGES])
    out = {"measurements": clean.select(key, "measured_on", F.explode(F.filter(measures, lambda m: m["value"].isNotNull())).alias("i")).select(key, "measured_on", "i.*")}
    lists = {"conditions": "known_diagnoses", "symptoms": "current_symptoms", "medications": "medications", "supplements": "supplements", "report_files": "reports", "labs": "labs", "food_logs": "food_log_days"}
    for name, column in lists.items():
        out[name] = clean.select(key, F.explode(column).alias("i")).select(key, "i.*")
    out["conditions"] = out["conditions"].drop("severity").withColumn("status", F.lit("ACTIVE"))
    return out


def answers(p: Column) -> Column:
    """map of field -> its answers in upper case; empty strings, lists and objects and nulls are no answers."""
    none = F.expr("cast(map() AS map<string,variant>)")
    bodies = F.transform(F.map_values(F.coalesce(at(p, "$.sections", "map<string,variant>"), none)), lambda b: F.map_entries(F.coalesce(F.try_variant_get(b, "$", "map<string,variant>"), none)))
    said = F.filter(F.flatten(bodies), lambda e: ~F.coalesce(F.to_json(e["value"]), F.lit("null")).isin("null", '""', "[]", "{}"))

    def words(v):
        many = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.upper(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))
        return F.coalesce(many, F.array(F.upper(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))))

    return F.transform(said, lambda e: F.struct(e["key"].alias("field"), words(e["value"]).alias("said")))


def validate(submissions: DataFrame, catalog: DataFrame, severities: dict[str, str], column: str = "raw_payload", key: str = "submission_id") -> DataFrame:
    """(key, missing_field, section, classification, severity) for applicable fields without an answer.

    catalog is a bounded registry, sent along as one row. A conditional field applies if an answer to its
    condition is among its values, or any of them begins with `__`; without that answer it doesn't apply.
    """
    cols = ["field_key", "section", "classification", "condition_field", "condition_values"]
    fields = catalog.filter("active and not rht_owned").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_fields"))
    rows = parse_payload(submissions.select(key, column), column).withColumn("_said", answers(F.col("p")))
    rows = rows.join(F.broadcast(fields))

    def missing(f):
        said = F.flatten(F.transform(F.filter("_said", lambda a: a["field"] == f["condition_field"]), lambda a: a["said"]))
        wanted = F.transform(F.coalesce(f["condition_values"], F.expr("cast(array() AS array<string>)")), F.upper)
        asked = F.exists("_said", lambda a: a["field"] == f["condition_field"]) & (F.exists(wanted, lambda w: w.startswith("__")) | F.arrays_overlap(said, wanted))
        return ~F.exists("_said", lambda a: a["field"] == f["field_key"]) & (f["condition_field"].isNull() | asked)

    gaps = rows.select(key, "p", F.explode(F.filter("_fields", missing)).alias("f"))
    off = F.expr("try_variant_get(try_variant_get(try_variant_get(p, '$.sections', 'map<string,variant>')[f.section], '$', 'map<string,variant>')['_not_applicable'], '$', 'boolean')")
    level = F.create_map(*[F.lit(x) for kv in severities.items() for x in kv])
    gaps = gaps.filter(~F.coalesce(off, F.lit(False)))
    return gaps.select(key, F.col("f.field_key").alias("missing_field"), "f.section", "f.classification", F.coalesce(F.try_element_at(level, F.col("f.classification")), F.lit("MODERATE")).alias("severity"))


def canonical_state(submissions: DataFrame, gaps: DataFrame, sections: list[str], statuses: list[str], column: str = "raw_payload", key: str = "submission_id") -> DataFrame:
    """(key, sections, high_priority, n_gaps, unusable): one row per submission.

    sections maps each of SECTIONS to UNKNOWN, NOT_APPLICABLE or the JSON of its body, in which cleaned fields
    stand in place of those submitted and keys that begin with _ are left out.
    """
    clean = sanitize(submissions.select(key, column), statuses, column)
    none = F.expr("cast(map() AS map<string,variant>)")
    own: dict[str, list[str]] = {"BASIC_PROFILE": list(RANGES), "LABS_REPORTS": ["lab_values"], "FOOD_LOG": ["food_log_days"]}
    for section, name in NAMED:
        own.setdefault(section, []).append(name)

    def state(section):
        body = F.coalesce(at(F.col("p"), f"$.sections.{section}", "map<string,variant>"), none)
        mine = own.get(section, [])
        rest = F.map_filter(body, lambda k, v: ~k.startswith("_") & ~k.isin(*mine))
        cols = {f: "labs" if f == "lab_values" else f for f in mine}
        fixed = F.map_from_entries(F.array(*[F.struct(F.lit(f), F.parse_json(F.to_json(F.struct(F.col(c).alias("v"))))) for f, c in cols.items()])) if mine else none
        kept = F.transform_values(F.map_filter(fixed, lambda k, v: F.map_contains_key(body, k)), lambda k, v: F.try_variant_get(v, "$.v", "variant"))
        kept = F.map_filter(kept, lambda k, v: v.isNotNull())
        whole = F.map_concat(rest, kept)
        off = F.coalesce(F.try_variant_get(F.try_element_at(body, F.lit("_not_applicable")), "$", "boolean"), F.lit(False))
        return F.when(off, "NOT_APPLICABLE").when(F.size(whole) == 0, UNKNOWN).otherwise(F.to_json(whole))

    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "missing_field")))
    by = gaps.groupBy(key).agg(listed.alias("_g"), F.count(F.lit(1)).alias("n_gaps"))
    high = F.transform(F.filter(F.coalesce("_g", F.expr("cast(array() AS array<struct<rank:bigint,missing_field:string>>)")), lambda g: g["rank"] <= 2), lambda g: g["missing_field"])
    table = F.create_map(*[x for s in SECTIONS for x in (F.lit(s), state(s))])
    rows = clean.select(key, table.alias("sections"), value_issues(F.col("p"), sections, statuses).alias("unusable"))
    return rows.join(by, key, "left").select(key, "sections", high.alias("high_priority"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), "unusable")
