"""Intake payloads on small frames: every rule once, and what is missing or isn't JSON."""

import json

from tessera.operators import intake

KNOWN, STATUSES = [*intake.SECTIONS, "RHT_LINKAGE"], ["COMPLETED", "NOT_ASSESSED"]

BAD = {
    "measured_on": "03/04/2026",
    "sections": {
        "BASIC_PROFILE": {"height_cm": "about 170", "weight_kg": 900, "waist_cm": " 80.5 ", "sex": "male"},
        "LABS_REPORTS": {
            "lab_dates": "2026-01-02",
            "lab_values": [{"marker": "A", "value": "1.5"}, {"marker": " "}, "x", {"marker": "B", "value": "high"}, {"marker": "C", "value": 2, "date": "14/08/2026", "ref_low": "no"}],
            "lab_reports": [1, {"date": "no", "filename": "f"}],
        },
        "MEDICATIONS": {"medications": ["m", " ", 4, {"dose": "1"}, {"name": "n", "dose": "2"}], "supplements": []},
        "SYMPTOMS": {"current_symptoms": [{"symptom": "s", "severity": 11}, {"symptom": "t", "severity": "3"}]},
        "DIAGNOSES_HISTORY": {"known_diagnoses": ["d"]},
        "FOOD_LOG": {"food_log_days": ["eggs", {"raw_text": "x"}, {"date": "2026-01-01", "raw_text": "y"}]},
        "RHT_LINKAGE": {"rht_status": "probably fine"},
        "DIGESTIVE": {"_not_applicable": True},
        "GOALS": "none",
        "ODD": {},
    },
}


def submissions(spark):
    return spark.createDataFrame([(1, json.dumps(BAD)), (2, "{}"), (3, "no json"), (4, None), (5, '{"sections": []}')], "submission_id int, raw_payload string")


def test_checks(spark):
    got = sorted((r.submission_id, r.field_path, r.action == "DROPPED") for r in intake.check_values(submissions(spark), KNOWN, STATUSES).collect())
    labs, meds, food = "LABS_REPORTS.lab_values", "MEDICATIONS.medications", "FOOD_LOG.food_log_days"
    dropped = [f"{labs}[1]", f"{labs}[2]", f"{labs}[3]", f"{labs}[4].date", "LABS_REPORTS.lab_reports[0]", f"{meds}[1]", f"{meds}[2]", f"{meds}[3].name", f"{food}[0]", f"{food}[1].date", "sections.ODD"]
    unknown = ["measured_on", "BASIC_PROFILE.height_cm", "BASIC_PROFILE.weight_kg", f"{labs}[4].ref_low", "LABS_REPORTS.lab_reports[1].date", "SYMPTOMS.current_symptoms[0].severity", "RHT_LINKAGE.rht_status", "sections.GOALS"]
    assert got == sorted([(1, p, True) for p in dropped] + [(1, p, False) for p in unknown] + [(5, "sections", False)])


def test_sanitize_and_extract(spark):
    clean = intake.sanitize(submissions(spark), STATUSES)
    got = {k: sorted(tuple(r)[1:] for r in df.collect()) for k, df in intake.extract(clean, "submission_id").items()}
    assert [(m, v) for _, m, v, _ in got["measurements"]] == [("waist_cm", 80.5)]
    assert [(r[0], r[1], str(r[5])) for r in got["labs"]] == [("A", 1.5, "2026-01-02")]
    assert got["medications"] == [("m", "UNKNOWN", "UNKNOWN", "UNKNOWN"), ("n", "2", "UNKNOWN", "UNKNOWN")] and not got["supplements"]
    assert got["symptoms"] == [("s", None), ("t", 3)] and got["conditions"] == [("d", "ACTIVE")]
    assert [(str(a), b) for a, b in got["food_logs"]] == [("2026-01-01", "y")] and len(got["report_files"]) == 1
    assert [r.rht_status for r in clean.orderBy("submission_id").collect()] == ["NOT_ASSESSED", None, None, None, None]


def test_gaps_and_state(spark):
    rows = [
        ("sex", "BASIC_PROFILE", "IDENTITY", None, None), ("cycle", "REPRODUCTIVE", "CORE", "sex", ["female"]), ("prostate", "REPRODUCTIVE", "CORE", "sex", ["Male"]), ("gut", "DIGESTIVE", "CORE", None, None),
        ("pain", "SYMPTOMS", "ODD", "sex", ["__ANY__"]),
    ]
    catalog = spark.createDataFrame([(*r, False, True) for r in rows], "field_key string, section string, classification string, condition_field string, condition_values array<string>, rht_owned boolean, active boolean")
    gaps = intake.validate(submissions(spark), catalog, {"CORE": "HIGH", "IDENTITY": "LOW"})
    got = {i: sorted((r.missing_field, r.severity) for r in gaps.collect() if r.submission_id == i) for i in range(1, 6)}
    assert got[1] == [("pain", "MODERATE"), ("prostate", "HIGH")]
    assert got[2] == got[3] == got[4] == got[5] == [("gut", "HIGH"), ("sex", "LOW")]
    state = {r.submission_id: r for r in intake.canonical_state(submissions(spark), gaps, KNOWN, STATUSES).collect()}
    assert len(state) == 5 and state[1].n_gaps == 2 and state[1].high_priority == ["prostate"] and len(state[1].unusable) == 19
    assert state[1].sections["DIGESTIVE"] == "NOT_APPLICABLE" and state[1].sections["GOALS"] == "UNKNOWN" and set(state[2].sections.values()) == {"UNKNOWN"}
    basic = json.loads(state[1].sections["BASIC_PROFILE"])
    assert basic == {"sex": "male", "waist_cm": 80.5}
    assert len(state[1].sections) == 13
