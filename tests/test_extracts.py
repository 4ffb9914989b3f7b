from pyspark.sql import functions as F

from houselights import schemas
from houselights.sources import extracts

HEADER = ("summary_cust_id,summary_cust_name,season_desc,price_type_group,paid_amt,zone_desc,perf_dt,order_dt,section,"
          "row,seat,attended")


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def ticket(cust, season, perf, kind="Single "):
    return f'{cust},"Doe, J",{season},{kind},25.5,Price 1 - Orch,{perf},{perf},A,1,7,Attended'


def test_preamble_is_dropped_from_every_file(spark, tmp_path):
    paths = [write(tmp_path / f"s{i}.csv", ["Report", "Season, all", "", HEADER,
                                            *[ticket(100 * i + j, "PS 18-19 Pops", "1/31/2019 8:00:00 PM")
                                              for j in range(i + 1)]]) for i in range(3)]
    rows = extracts.read_ticket_extracts(spark, paths).collect()
    assert sorted(r.summary_cust_id for r in rows) == [0, 100, 101, 200, 201, 202]
    assert {r.price_type_group for r in rows} == {"Single "} and {r.summary_cust_name for r in rows} == {"Doe, J"}
    assert {str(r.perf_dt) for r in rows} == {"2019-01-31 20:00:00"}


def test_large_file_read_in_many_splits(spark, tmp_path):
    n = 3000
    path = write(tmp_path / "big.csv", ["a", "b", "c", HEADER, *[ticket(i, "PS 18-19 Pops", "1/31/2019 8:00:00 PM")
                                                                 for i in range(n)]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = extracts.read_ticket_extracts(spark, path)
        assert df.rdd.getNumPartitions() > 5
        assert sorted(r.summary_cust_id for r in df.select("summary_cust_id").collect()) == list(range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_small_files_in_one_task(spark, tmp_path):
    for i in range(40):
        write(tmp_path / f"f{i}.csv", ["x", "y", "z", HEADER, ticket(i, "PS 18-19 Pops", "1/31/2019 8:00:00 PM")])
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = extracts.read_ticket_extracts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.summary_cust_id for r in rows) == list(range(40))


def test_season_without_seconds(spark, tmp_path):
    write(tmp_path / "a.csv", ["1", "2", "3", HEADER, ticket(1, "PS 15-16 Summer", "7/4/2016 19:30")])
    write(tmp_path / "b.csv", ["1", "2", "3", HEADER, ticket(2, "PS 16-17 Summer", "7/4/2017 7:30:00 PM")])
    rows = extracts.read_ticket_extracts(spark, str(tmp_path)).orderBy("summary_cust_id").collect()
    assert [str(r.perf_dt) for r in rows] == ["2016-07-04 19:30:00", "2017-07-04 19:30:00"]


def test_other_preamble_depths(spark, tmp_path):
    for depth in (6, 7):
        path = write(tmp_path / f"b{depth}.csv", ["note"] * depth + ["customer_no,key_value", "5,1950", "6,0"])
        rows = extracts.read_birth_years(spark, path, preamble=depth).collect()
        assert sorted(map(tuple, rows)) == [(5, 1950), (6, 0)]


def test_plain_csv(spark, tmp_path):
    gifts = write(tmp_path / "d.csv", ["summary_cust_id,gift_plus_pledge,cont_fy,campaign,fund_desc",
                                       "1,10.5,2018,PS 17-18 Annual,Fund"])
    assert extracts.load_donations(spark, gifts).first().gift_plus_pledge == 10.5
    shows = write(tmp_path / "p.csv", ["perf_dt,name", "2019-01-31 20:00:00,Ninth"])
    row = extracts.read_performances(spark, shows).first()
    assert (str(row.perf_dt), row.name) == ("2019-01-31 20:00:00", "Ninth")


def test_extract_written_and_read_back(spark, table, tmp_path):
    df = table([(1, 1950), (2, 0)], "customer_no bigint, key_value int").repartition(3)
    extracts.write_extract(df, str(tmp_path / "x"), ["note"] * 7)
    assert sorted(map(tuple, extracts.read_birth_years(spark, str(tmp_path / "x")).collect())) == [(1, 1950), (2, 0)]
    assert schemas.BIRTH_YEARS.startswith("customer_no")


def test_only_named_seasons_are_scanned(spark, tickets, tmp_path):
    path = str(tmp_path / "store")
    extracts.store_by_season(tickets([(1, "Flex", 10, "2019-01-31 20:00:00", None, s)
                                      for s in ("PS 17-18 Pops", "PS 18-19 Pops", "PS 18-19 Classics")]), path)
    one = extracts.load_tickets(spark, path, ["PS 18-19 Pops"])
    assert [r.season_desc for r in one.collect()] == ["PS 18-19 Pops"] and "season" not in one.columns
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "season" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_report_sheets_replace_then_append(spark, table, tmp_path):
    path = str(tmp_path / "report")
    a, b = table([(1,)], "n int"), table([("x", 1), ("y", 2)], "grp string, n int")
    extracts.save_report({"one": a, "two": b}, path)
    extracts.save_report({"one": a}, path)
    extracts.save_report({"two": b}, path, append=True)
    assert extracts.load_sheet(spark, path, "one").count() == 1 and extracts.load_sheet(spark, path, "two").count() == 4
    extracts.save_grouped_report(b, str(tmp_path / "by"), "grp")
    assert spark.read.parquet(str(tmp_path / "by" / "grp=y")).agg(F.sum("n")).first()[0] == 2
