"""Text feeds in hand-made files, through to the wide panels and the network."""

import datetime

import pytest
from pyspark.sql import functions as F

from voltweave import jobs
from voltweave.functions.fixed import ZONE_TO_COUNTRY
from voltweave.sources import market, tables

DAY = datetime.date


def write(path, header, rows, sep="\t"):
    path.write_text("\n".join(sep.join(map(str, r)) for r in [header, *rows]) + "\n")
    return str(path)


def test_zone_table_covers_every_zone():
    assert len(ZONE_TO_COUNTRY) == 48 and len(set(ZONE_TO_COUNTRY.values())) == 31
    assert ZONE_TO_COUNTRY["DE_LU"] == "DE" and ZONE_TO_COUNTRY["NO2NSL"] == "NO"


def test_generation_files(spark, tmp_path):
    head = ["Extra", "DateTime(UTC)", "ProductionType", "AreaMapCode", "ActualGenerationOutput[MW]"]
    write(tmp_path / "2025_01_x.csv", head, [
        (1, "2025-01-01 00:00:00", "Solar", "AT", 1.5), (1, "2025-01-01 23:45:00", "Solar", "AT", 2.0),
        (1, "2025-01-01 10:00:00", "Wind Onshore", "AT", 4.0), (1, "2025-01-01 10:00:00", "Wind Offshore", "AT", 5.0),
        (1, "2025-01-01 10:00:00", "Nuclear", "AT", 99), (1, "2025-01-01 10:00:00", "Solar", "XX", 99),
        (1, "2025-01-02 10:00:00", "Solar", "BE", "")])
    write(tmp_path / "2025_02_x.csv", head[1:], [("2025-01-01 05:00:00", "Solar", "AT", 10)])
    got = jobs.generation(spark, [str(tmp_path / "*.csv")]).orderBy("date").collect()
    assert got[0].asDict() == {"date": DAY(2025, 1, 1), "AT_Solar": 13.5, "AT_Wind": 9.0, "BE_Solar": 0.0}
    assert got[1].asDict() == {"date": DAY(2025, 1, 2), "AT_Solar": 0.0, "AT_Wind": 0.0, "BE_Solar": 0.0}


def test_load_detects_separator(spark, tmp_path):
    head = ["DateTime(UTC)", "AreaMapCode", "TotalLoad[MW]"]
    a = write(tmp_path / "a.csv", head, [("2025-01-01 00:00:00", "AT", 10), ("2025-01-01 01:00:00", "AT", "")], ",")
    c = write(tmp_path / "c.csv", head, [("2025-01-01 02:00:00", "AT", 40), ("2025-01-01 03:00:00", "GB", 7)])
    got = jobs.load(spark, [a, c]).collect()
    assert [r.asDict() for r in got] == [{"date": DAY(2025, 1, 1), "AT_Load": 25.0, "GB_Load": 7.0}]


def test_price_is_a_mean_of_zone_means(spark, tmp_path):
    f = write(tmp_path / "p.csv", ["DateTime(UTC)", "MapCode", "Price[Currency/MWh]"], [
        ("2025-01-01 00:00:00", "DK1", 10), ("2025-01-01 01:00:00", "DK1", 20), ("2025-01-01 02:00:00", "DK1", 30),
        ("2025-01-01 00:00:00", "DK2", 100), ("2025-01-01 00:00:00", " DK2", 9999), ("2025-01-02 00:00:00", "AT", 5)])
    got = {r.date: r.asDict() for r in jobs.price(spark, [f]).collect()}
    assert got[DAY(2025, 1, 1)]["DK_Price"] == 60.0 and got[DAY(2025, 1, 1)]["AT_Price"] is None
    assert got[DAY(2025, 1, 2)]["AT_Price"] == 5.0


def test_reserve_margin_with_zero_load(spark, tmp_path):
    g = write(tmp_path / "g.csv", ["DateTime(UTC)", "AreaMapCode", "GenerationForecast[MW]"], [
        ("2025-01-01 00:00:00", "AT", 60), ("2025-01-01 01:00:00", "AT", 60), ("2025-01-01 00:00:00", "BE", 5),
        ("2025-01-02 00:00:00", "AT", 1)])
    d = write(tmp_path / "l.csv", ["DateTime(UTC)", "AreaMapCode", "TotalLoad[MW]"], [
        ("2025-01-01 00:00:00", "AT", 100), ("2025-01-01 00:00:00", "BE", 0)])
    got = jobs.reserve(spark, [g], [d]).collect()
    assert len(got) == 1 and got[0]["AT_RM"] == pytest.approx(0.2) and got[0]["BE_RM"] is None
    other = write(tmp_path / "o.csv", ["DateTime(UTC)", "AreaMapCode", "TotalLoad[MW]"], [("2024-01-01 00:00:00", "AT", 1)])
    with pytest.raises(ValueError, match="share no day"):
        jobs.reserve(spark, [g], [other])


CAPACITY = [c for c in market.FEEDS["transfer_capacity"].columns]


def capacity_row(ts, a, b, mw, contract="D", a_code=None, b_code=None):
    return (ts, a_code or a, a, a, b_code or b, b, b, mw, contract, "PT60M")


def test_network_rules(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    t = "2025-01-01 00:00:00"
    write(src / "1.csv", CAPACITY, [
        capacity_row(t, "AT", "DE_50HZ", 500.0), capacity_row(t, "AT", "DE_50HZ", 9000.0),
        capacity_row(t, "BE", "FR", 0), capacity_row(t, "FR", "BE", -3), capacity_row(t, "AT", "AT", 900),
        capacity_row(t, "XX", "AT", 800), capacity_row("2025-01-01 01:00:00", "FR", "BE", 499.9)])
    write(src / "2.csv", CAPACITY, [capacity_row(t, "AT", "DE_50HZ", 7000.0)])
    matrix, nodes = jobs.transfer_network(spark, str(src), 500.0, "mean")
    cells = {(r.src, r.dst): (r.capacity_mw, r.g0) for r in matrix.collect()}
    assert [r.node for r in nodes.orderBy("idx").collect()] == ["AT", "BE", "DE", "FR"]
    assert len(cells) == 16
    # First record of a duplicated key counts; the threshold is inclusive; no self-loop.
    assert cells["AT", "DE"] == (500.0, 1) and cells["AT", "AT"] == (900.0, 0)
    assert cells["FR", "BE"] == (499.9, 0) and cells["BE", "FR"] == (0.0, 0)
    jobs.main(["network", "--data_dir", str(src), "--output_dir", str(out), "--agg", "median"])
    back = {(r.src, r.dst): r.value for r in tables.read_matrix_csv(spark, f"{out}/G0_matrix").collect()}
    assert back == {k: float(v[1]) for k, v in cells.items()}
    keep = tmp_path / "keep.csv"
    keep.write_text("country\nDE\nAT\n")
    sub = {(r.i, r.j): r.value for r in jobs.filtered_network(spark, f"{out}/G0_matrix", str(keep)).collect()}
    assert sub == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}
    keep.write_text("country\nDE\nPL\n")
    with pytest.raises(ValueError, match="PL"):
        jobs.filtered_network(spark, f"{out}/G0_matrix", str(keep))
    with pytest.raises(ValueError, match="must differ"):
        jobs.main(["network", "--data_dir", str(src), "--output_dir", str(src)])


def test_missing_files_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        market.read_capacity_dir(spark, str(tmp_path))
    assert market.expand_paths(spark, [str(tmp_path / "none*.csv")]) == [str(tmp_path / "none*.csv")]
    bad = write(tmp_path / "bad.csv", ["DateTime(UTC)", "AreaMapCode"], [])
    with pytest.raises(ValueError, match="missing columns"):
        market.read_feed(spark, "load", [bad])


def test_block_panel_and_draw_checks(spark, tmp_path):
    rows = [(DAY(2025, 1, d), v, b, 1.0) for b, v, n in (("Y", "AT_Price", 3), ("X", "AT_Wind", 2)) for d in range(1, n + 1)]
    df = spark.createDataFrame(rows, "date date, variable string, block string, value double")
    tables.write_panel(df, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="row counts differ"):
        tables.read_panel(spark, str(tmp_path / "p"))
    draws = spark.range(6).select((F.col("id") % 2).cast("int").alias("chain"), F.col("id").alias("draw"),
                                  F.lit(0.1).alias("mu_h"), F.lit(1.0).alias("sigma_h2"))
    tables.write_draws(draws, str(tmp_path / "d"))
    assert "mu_h" not in tables.read_draws(spark, str(tmp_path / "d"), 2).columns
    with pytest.raises(FileNotFoundError, match="2"):
        tables.read_draws(spark, str(tmp_path / "d"), 3)
