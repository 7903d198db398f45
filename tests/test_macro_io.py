import tempfile

from riskweave.sources.macro import country_lookup, read_macro, read_mapping
from riskweave.sources.versions import replace_table


def test_read_macro_csv_and_parquet(spark):
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{d}/macro.csv", "w") as f:
        f.write("country_code,country_name,year,gdp_usd,frequency,indicator_type\n")
        f.write("KEN,Kenya,2010,1.5,Annual,GDP\n")
    m = read_macro(spark, f"{d}/macro.csv", fmt="csv")
    assert dict(m.dtypes) == {"country_code": "string", "country_name": "string", "year": "string",
                              "gdp_usd": "double", "frequency": "string", "indicator_type": "string"}
    replace_table(m, f"{d}/macro_pq")
    assert read_macro(spark, f"{d}/macro_pq").first().gdp_usd == 1.5


def test_mapping_fallback_when_missing(spark):
    assert read_mapping(spark, "/tmp/definitely-missing-mapping-table") is None
    assert read_mapping(spark, None) is None
    got = {r.country_name: r.country_code for r in country_lookup(spark, None).collect()}
    assert got["Kenya"] == "KEN"
