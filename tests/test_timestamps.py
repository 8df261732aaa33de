"""The cascade against instants worked out by hand, and the defined results of odd inputs."""

from pyspark.sql import functions as F

from lectern.functions.timestamps import parsed, utc_text

CASES = [
    ("2023-07-13 20:05:22 CEST", "Europe/Paris", False, "2023-07-13T18:05:22.000000Z"),
    ("abr 26, 2023 | 5:04 a. m.", "America/Santo_Domingo", False, "2023-04-26T09:04:00.000000Z"),
    ("26 de Marzo de 2023 a las 02:30 h", "Europe/Madrid", False, "2023-03-26T01:30:00.000000Z"),  # skipped by the change
    ("29/10/2023 02:30", "Europe/Madrid", False, "2023-10-29T00:30:00.000000Z"),  # occurs twice
    ("November 5, 2023 at 1:30 AM ET", "America/New_York", True, "2023-11-05T05:30:00.000000Z"),
    ("2023-11-05 01:30:00 EST", "America/New_York", True, "2023-11-05T06:30:00.000000Z"),
    ("08/13/2025 9:38 AM", "America/New_York", True, "2025-08-13T13:38:00.000000Z"),
    ("13/08/2025 9:38", "Europe/London", False, "2025-08-13T08:38:00.000000Z"),
    ("2024-09-19T13:53:32.483203951-05:00", "Asia/Kolkata", False, "2024-09-19T18:53:32.483203Z"),
    ("2025-11-04T17:14:45−00:00", "Asia/Tokyo", False, "2025-11-04T17:14:45.000000Z"),
    ("2023-09-02 12:01:06 UTC+5:30", "Asia/Kolkata", False, "2023-09-02T06:31:06.000000Z"),
    ("2024-01-10 10:00:00 CST", "Asia/Taipei", False, "2024-01-10T02:00:00.000000Z"),
    ("2024-01-10 10:00:00 CST", "America/Chicago", True, "2024-01-10T16:00:00.000000Z"),
    ("2025-04-12 10:14:58[America/Argentina/Buenos_Aires]", "Europe/Paris", False, "2025-04-12T13:14:58.000000Z"),
    ("2024年1月24日 20時28分", "Asia/Tokyo", False, "2024-01-24T11:28:00.000000Z"),
    ("21. November 2025, 23:01 Uhr", "Europe/Berlin", False, "2025-11-21T22:01:00.000000Z"),
    ("20 septembre 2024 à 13h50", "Europe/Paris", False, "2024-09-20T11:50:00.000000Z"),
    ("15-ago-23 18:00", "America/Santo_Domingo", False, "2023-08-15T22:00:00.000000Z"),
    ("Mon, 24 Apr 2023 00:49:58 GMT", "Europe/Madrid", False, "2023-04-24T00:49:58.000000Z"),
    ("20250707", "America/Santo_Domingo", False, "2025-07-07T04:00:00.000000Z"),
    ("1674635274084", None, False, "2023-01-25T08:27:54.084000Z"),
    ("1678990008", None, False, "2023-03-16T18:06:48.000000Z"),
]
NONE = ["ayer", "2 hours ago", "hace 3 horas", "24 sep", "03:58", "", " ", "N/D", "null", "2024-13-05 08:00:00", "2024-02-30T10:15:00-04:00", "2025-06-18T25:61:00Z", "x" * 5000, "2024-01-01 10:00 Mars/Base"]


def test_cascade(spark):
    rows = [(i, t, z, m) for i, (t, z, m, _) in enumerate(CASES)] + [(1000 + i, t, "Europe/Paris", False) for i, t in enumerate(NONE)] + [(2000, None, "Europe/Paris", False), (2001, "2024-01-01", None, False), (2002, "2024-01-01", "No/Zone", False)]
    df = spark.createDataFrame(rows, "id int, t string, z string, m boolean")
    got = {r.id: r.u for r in df.select("id", utc_text(parsed(F.col("t"), F.col("z"), F.col("m"))).alias("u")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]
    assert all(v is None for k, v in got.items() if k >= 1000)


def test_query_merges_repeats_and_finds_sites_by_domain(spark, tmp_path):
    from lectern.plans.dates import p1_found

    spark.createDataFrame([(1, "site.example", "es_DO", "America/Santo_Domingo")], "id long, domain string, locale string, timezone string").write.parquet(f"{tmp_path}/sources.parquet")
    rows = [(7, 1, None, "2024-01-01 00:00"), (7, 1, None, "2024-01-01 00:00"), (8, None, " WWW.Site.example", "2024-01-01 00:00"), (None, 1, None, "2024-01-01"), (9, None, None, "2024-01-01")]
    spark.createDataFrame([(*r, "x") for r in rows], "id long, source_id long, source_domain string, published_date string, timezone string").write.parquet(f"{tmp_path}/articles.parquet")
    assert sorted(map(tuple, p1_found(spark, str(tmp_path)).collect())) == [(7, "2024-01-01T04:00:00.000000Z"), (8, "2024-01-01T04:00:00.000000Z")]


def test_empty_table(spark, tmp_path):
    from lectern.plans.dates import p1_found

    spark.createDataFrame([], "id long, domain string, locale string, timezone string").write.parquet(f"{tmp_path}/sources.parquet")
    spark.createDataFrame([], "id long, source_id long, source_domain string, published_date string").write.parquet(f"{tmp_path}/articles.parquet")
    assert p1_found(spark, str(tmp_path)).count() == 0
