from epiframe.plans.enrichment import enrich, unmatched_countries
from epiframe.schemas import ENRICHED
from epiframe.sources.files import mapping_keys

PANEL_DDL = "country_region string, date date, cases long, deaths long, cases_since_prev_day long, population long"


def _panel(spark, rows):
    import datetime as dt
    return spark.createDataFrame([(c, dt.date(2020, 1, d), x, y, None, None) for c, d, x, y in rows], PANEL_DDL)


def test_enrich_hand_table(spark):
    panel = _panel(spark, [
        ("Alpha", 1, 10, 1), ("Alpha", 2, 30, None),          # totals 40 / 1
        ("\tBeta ", 1, 5, 5),                             # key with tab and nbsp
        ("Gamma", 1, 0, 0),                                    # zero cases -> CFR NULL
        ("Delta", 1, 7, None),                                 # all-null deaths stays NULL
        ("Mapped", 1, 2, 1),                                   # goes through the mapping
        (None, 1, 3, 3),                                       # null key: never matches
    ])
    dim = spark.createDataFrame([
        ("alpha", "X", 1_000_000, 100), ("BETA", "X", 0, 0), ("gamma", "Y", None, 10),
        ("Delta ", "Y", 2_000_000, None), ("Target Name", "Z", 500_000, 50)],
        "country string, continent string, population_2020 long, area_km2 long")
    mapping = mapping_keys(spark.createDataFrame([("mapped ", "target name")], "source_name string, target_name string"))
    out = {r["country_region"]: r for r in enrich(panel, dim, mapping).collect()}
    assert set(out) == {"Alpha", "\tBeta ", "Gamma", "Delta", "Mapped"}
    a = out["Alpha"]
    assert (a.total_cases, a.total_deaths, a.cases_per_million, a.cfr_pct, a.cases_per_km2) == (40, 1, 40.0, 2.5, 0.4)
    b = out["\tBeta "]
    assert b.cases_per_million is None and b.cases_per_km2 is None and b.population_density_calc is None
    assert out["Gamma"].cfr_pct is None and out["Gamma"].cases_per_million is None
    assert out["Delta"].total_deaths is None and out["Delta"].cases_per_km2 is None
    assert out["Mapped"].population_2020 == 500_000
    assert enrich(panel, dim, mapping).schema == ENRICHED or \
        [f.name for f in enrich(panel, dim, mapping).schema] == [f.name for f in ENRICHED]


def test_mapping_fan_out_and_unmatched(spark):
    panel = _panel(spark, [("Dup", 1, 4, 2), ("Lost", 1, 1, 1)])
    dim = spark.createDataFrame([("one", "X", 10, 1), ("two", "X", 20, 2)],
                                "country string, continent string, population_2020 long, area_km2 long")
    # a duplicated source name in the mapping fans the row out, as a left join does
    mapping = mapping_keys(spark.createDataFrame([("dup", "one"), ("DUP", "two"), ("lost", "nowhere")],
                                                 "source_name string, target_name string"))
    assert sorted(r.population_2020 for r in enrich(panel, dim, mapping).collect()) == [10, 20]
    lost = unmatched_countries(panel, dim, mapping).collect()
    assert [(r.country_region, r.country_key) for r in lost] == [("Lost", "nowhere")]


def test_empty_input(spark):
    empty = _panel(spark, []).limit(0)
    dim = spark.createDataFrame([], "country string, continent string, population_2020 long, area_km2 long")
    mapping = mapping_keys(spark.createDataFrame([], "source_name string, target_name string"))
    assert enrich(empty, dim, mapping).count() == 0
