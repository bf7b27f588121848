import pytest
from pyspark.sql import functions as F

from doseloom.functions.entries import parse, parse_entries, split_list, split_lists

#: Golden values: text -> name, strength, unit, times a day, total.
PLAIN = {
    "10 mg Zyprexa X 1 daily": ("Zyprexa", 10.0, "mg", 1.0, 10.0), "20 mg adderall X 3 daily": ("adderall", 20.0, "mg", 3.0, 60.0), "10 mg ambien X daily": ("ambien", 10.0, "mg", 1.0, 10.0),
    "Flexril 10 mg X 3 times daily": ("Flexril", 10.0, "mg", 3.0, 30.0), "Venlafaxine ER 75 mg 1 time daily": ("Venlafaxine ER", 75.0, "mg", 1.0, 75.0), "Lyrica 100 mg tid": ("Lyrica", 100.0, "mg", 3.0, 300.0),
    "Albuterol 90 mcg 2 puffs as needed": ("Albuterol", 90.0, "mcg", None, None), "Trazodone 50 mg 1 time daily at bedtime": ("Trazodone", 50.0, "mg", 1.0, 50.0), "Ozempic 1 mg once weekly": ("Ozempic", 1.0, "mg", None, None),
    "Duragesic 25 mcg/h one patch every 72 hours": ("Duragesic", 25.0, "mcg/h", 1 / 3, 25.0), "Tylenol 500 mg 2 tablets three times daily": ("Tylenol", 500.0, "mg", 3.0, 3000.0), "Advil 200 mg 2 tablets twice daily": ("Advil", 200.0, "mg", 2.0, 800.0),
    "Norco 10/325 mg qid": ("Norco", 10.0, "mg", 4.0, 40.0), "Xanax 1/2 tablet": ("Xanax 1/", None, None, None, None), "??": ("??", None, None, None, None), "5 mg daily": ("", 5.0, "mg", 1.0, 5.0),
    "aspirin every 6 hrs": ("aspirin", None, None, 4.0, None), "fentanyl 50 mcg/hr": ("fentanyl", 50.0, "mcg/h", None, 50.0), "cream 1% bid": ("cream", 1.0, "%", 2.0, 2.0), "x 12.5mgs": ("x 12.5mgs", None, None, None, None),
}
#: Golden values: brand and generic forms -> what is asserted.
WRITTEN = {
    "Xanax (alprazolam) 1 mg three times daily = 3 mg/day": {"name_text": "alprazolam", "brand_text": "Xanax", "daily_total": 3.0, "stated_total": "3 mg/day"},
    "sertraline (generic) 50 mg once daily = 50 mg/day": {"name_text": "sertraline", "brand_text": None},
    "Lithobid (lithium carbonate ER) 300 mg three times daily = 900 mg/day": {"name_text": "lithium carbonate", "release_form": "extended-release", "daily_total": 900.0},
    "Aleve (naproxen sodium OTC) 220 mg twice daily = 440 mg/day": {"name_text": "naproxen sodium"},
    "Norco (hydrocodone/acetaminophen) 10/325 mg four times daily = 40/1300 mg/day": {"components": ["hydrocodone", "acetaminophen"], "component_strengths": [{"value": 10.0, "unit": "mg"}, {"value": 325.0, "unit": "mg"}], "name_text": "hydrocodone and acetaminophen"},
    "Sprintec (norgestimate/ethinyl estradiol) 0.25 mg/35 mcg once daily = 0.25 mg/35 mcg/day": {"component_strengths": [{"value": 0.25, "unit": "mg"}, {"value": 35.0, "unit": "mcg"}]},
    "Fioricet (butalbital/acetaminophen/caffeine) 50/325/40 mg 2 tablets every 4 hours as needed max 6 tablets/day = 300/1950/240 mg/day max": {"as_needed": True, "dose_count": 2.0, "times_per_day": 3.0, "name_text": "butalbital, acetaminophen and caffeine"},
    "Coumadin (warfarin) 5 mg once daily Mon/Wed/Fri = 5 mg on those days": {"days_per_week": 3.0, "schedule_text": "Mon/Wed/Fri", "name_text": "warfarin"},
    "Trexall (methotrexate) 15 mg once weekly = 15 mg/week": {"daily_total": None, "days_per_week": 1.0},
    "Roxicodone (oxycodone IR) 10 mg every 4 hours as needed max 6 doses/day = 60 mg/day max": {"daily_total": 60.0},
    "Imitrex (sumatriptan) 50 mg as needed may repeat once after 2 hours = 100 mg/day max": {"daily_total": 100.0},
    "Viagra (sildenafil) 100 mg as needed no more than once daily = 100 mg/day max": {"daily_total": 100.0},
    "Maxalt (rizatriptan) 10 mg as needed may repeat after 2 hours max 30 mg/day = 30 mg/day max": {"daily_total": 30.0},
    "Flonase (fluticasone propionate nasal) 50 mcg per spray 2 sprays each nostril once daily = 200 mcg/day": {"name_text": "fluticasone propionate", "dose_count": 4.0, "daily_total": 200.0, "route": "nasal"},
    "Zosyn (piperacillin/tazobactam) 3.375 g IV every 6 hours = 13.5 g/day": {"strength_unit": "g", "daily_total": 13.5, "route": "intravenous"},
    "Lantus (insulin glargine) 40 units subcutaneous once daily at bedtime = 40 units/day": {"name_text": "insulin glargine", "strength_unit": "units", "daily_total": 40.0},
    "Klor-Con (potassium chloride ER) 20 mEq once daily = 20 mEq/day": {"strength_unit": "mEq"},
    "Duragesic (fentanyl) 25 mcg/h transdermal patch one patch every 72 hours = 25 mcg/h continuous": {"name_text": "fentanyl", "strength_unit": "mcg/h", "daily_total": 25.0},
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_forms(text):
    e = parse(text)
    assert (e.name_text, e.strength_value, e.strength_unit, e.times_per_day, e.daily_total) == PLAIN[text]


@pytest.mark.parametrize("text", WRITTEN)
def test_written_generics(text):
    e = parse(text)
    assert {k: getattr(e, k) for k in WRITTEN[text]} == WRITTEN[text]


def test_notes():
    assert parse("10 mg Zyprexa X 1 daily").notes == [] and any("once daily" in n for n in parse("ambien 10 mg X daily").notes)
    assert any("no frequency" in n for n in parse("??").notes) and any("no drug name" in n for n in parse("5 mg").notes) and any("per-dose count of 2" in n for n in parse("a 5 mg 2 caps bid").notes)
    assert any("10/325 mg" in n for n in parse("Norco 10/325 mg qid").notes) and any("24 divided" in n for n in parse("a 5 mg q12h").notes)


def test_lists():
    assert split_list("a, b; c\nd,,") == ["a", "b", "c", "d"] and split_list("") == split_list("  ") == []
    assert split_list("Glucophage 1,000 mg twice daily, Zoloft 50 mg") == ["Glucophage 1000 mg twice daily", "Zoloft 50 mg"]
    assert split_list("Adderall 30 mg Valium 20 mg oxycodone 5 mg") == ["Adderall 30 mg", "Valium 20 mg", "oxycodone 5 mg"]
    assert split_list("Xanax 1 mg tid = 3 mg/day Valium 5mg twice daily") == ["Xanax 1 mg tid = 3 mg/day", "Valium 5mg twice daily"]


def test_operators(spark):
    df = spark.createDataFrame([(1, "Abc 5 mg bid, Def (ghi/jkl) 5/6 mg daily"), (2, None), (3, ""), (4, "x " * 20_000)], "id int, t string")
    rows = split_lists(df, "t")
    got = {(r.id, r.pos): r.parsed for r in parse_entries(rows, "entry").collect()}
    assert set(got) == {(1, 1), (1, 2), (4, 1)} and got[1, 2].component_strengths[1].value == 6.0 and got[1, 1].daily_total == 10.0
    assert parse_entries(df, "t").where("id = 2").first().parsed is None and parse_entries(df.limit(0), "t").count() == 0
    with pytest.raises(ValueError):
        parse_entries(df, "t", "id")
    with pytest.raises(ValueError):
        split_lists(df.withColumnRenamed("id", "pos"), "t")
