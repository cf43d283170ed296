import os

from epiframe.sources import parse_record_array, parse_records, read_enriched, read_mapping, read_population, to_records, write_csv
from epiframe.schemas import ENRICHED

POP_HEADER = ("Rank,CCA3,Country/Territory,Capital,Continent,2022 Population,2020 Population,2015 Population,"
              "2010 Population,2000 Population,1990 Population,1980 Population,1970 Population,Area (km²),"
              "Density (per km²),Growth Rate,World Population Percentage")


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_population_csv_coerces_and_keys(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "pop.csv"), "\n".join([
        POP_HEADER,
        '1,AAA,Alpha,"Washington, D.C.",Asia,100,90,1,1,1,1,1,1,50,2.0,1.0,0.1',
        "2,BBB, Côte d'Ivoire ,Yamoussoukro,Africa,abc,80,1,1,1,1,1,1,0,0,1.0,0.1",
        "3,CCC,Gamma,X,Europe,300,7.0,1,1,1,1,1,1,n/a,x,1.0,0.1",
    ]) + "\n")
    rows = {r.country: r for r in read_population(spark, p).collect()}
    assert rows["Alpha"].population == 100 and rows["Alpha"].population_2020 == 90 and rows["Alpha"].area_km2 == 50
    assert rows[" Côte d'Ivoire "].population is None and rows[" Côte d'Ivoire "].area_km2 == 0
    assert rows["Gamma"].population_2020 == 7 and rows["Gamma"].area_km2 is None
    assert rows[" Côte d'Ivoire "].dim_key == "côte d'ivoire"


def test_mapping_csv(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "map.csv"),
               'source_name,target_name\n"Korea, Republic of",South Korea\nCôte d\'Ivoire , Cote d\'Ivoire\n')
    got = sorted(tuple(r) for r in read_mapping(spark, p).collect())
    assert got == [("côte d'ivoire", "cote d'ivoire"), ("korea, republic of", "south korea")]


def test_enriched_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("A", 10, 1, 100, 5, 1.0, 2.0, 10.0, 2.0, 0.2, 20.0),
                                ("B", 3, None, None, 0, None, None, None, None, None, None)], ENRICHED)
    out = write_csv(df, os.path.join(tmp_dir, "enriched_csv"))
    header = open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0], encoding="utf-8").readline()
    assert header.strip().startswith("COUNTRY_REGION,Total_Cases") and "CFR_%" in header
    back = read_enriched(spark, out, "csv")
    assert back.schema == ENRICHED or [f.name for f in back.schema] == [f.name for f in ENRICHED]
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_records_round_trip(spark):
    import datetime as dt
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("ds", T.DateType()), T.StructField("y", T.DoubleType())])
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 3.0), (dt.date(2020, 1, 2), None)], schema)
    rec = to_records(df)
    assert parse_records(rec, "record", schema).collect() == df.collect()
    arr = spark.createDataFrame([('[{"ds":"2020-01-01","y":1.5},{"ds":"2020-01-03","y":2}]',)], "j string")
    assert [tuple(r) for r in parse_record_array(arr, "j", schema).collect()] == [(dt.date(2020, 1, 1), 1.5), (dt.date(2020, 1, 3), 2.0)]


def test_x1_from_csv_files_to_csv_and_profile(spark, tmp_dir):
    """X1 as the reference runs it: population + mapping CSVs, enrichment,
    CSV sink with the published header, re-read, then a profile."""
    import datetime as dt
    from epiframe.operators import profile as pf
    from epiframe.plans.enrichment import enrich
    pop = _write(os.path.join(tmp_dir, "pop.csv"), "\n".join([
        POP_HEADER,
        "1,AAA,Czech Republic,Prague,Europe,100,1000000,1,1,1,1,1,1,50,2.0,1.0,0.1",
        '2,BBB,"Korea, South",Seoul,Asia,200,2000000,1,1,1,1,1,1,0,0,1.0,0.1',
        "3,CCC,Nowhere Land,X,Europe,300,3000000,1,1,1,1,1,1,10,1,1.0,0.1",
    ]) + "\n")
    mp = _write(os.path.join(tmp_dir, "map.csv"), 'a,b\nCzechia,Czech Republic\n"Korea, Republic of","Korea, South"\n')
    panel = spark.createDataFrame(
        [("Czechia", dt.date(2020, 1, 1), 10, 1, None, None), ("Czechia", dt.date(2020, 1, 2), 30, None, 20, None),
         ("Korea, Republic of", dt.date(2020, 1, 1), 5, 0, None, None), ("Atlantis", dt.date(2020, 1, 1), 1, 1, None, None)],
        "country_region string, date date, cases long, deaths long, cases_since_prev_day long, population long")
    enriched = enrich(panel, read_population(spark, pop), read_mapping(spark, mp, "a", "b"))
    out = write_csv(enriched, os.path.join(tmp_dir, "enriched"))
    back = read_enriched(spark, out, "csv")
    rows = {r.country_region: r for r in back.collect()}
    assert set(rows) == {"Czechia", "Korea, Republic of"}            # Atlantis has no dimension row
    cz, kr = rows["Czechia"], rows["Korea, Republic of"]
    assert (cz.total_cases, cz.total_deaths, cz.cases_per_million, cz.cfr_pct, cz.cases_per_km2) == (40, 1, 40.0, 2.5, 0.8)
    assert kr.cases_per_km2 is None and kr.cfr_pct == 0.0          # zero area -> NULL, zero deaths -> 0 %
    prof = {r.column_name: r for r in pf.numeric_summary(back).collect()}
    assert prof["total_cases"].n == 2 and prof["cases_per_km2"].n_missing == 1
