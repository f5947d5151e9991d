"""Period tables: sources, alignment, transformations and the observables plan."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from panelspark.functions import numeric, periods
from panelspark.operators import align, labels, series
from panelspark.plans.observables import RawFile, level_series, observables, tables_from_files
from panelspark.sources import tables as io
from conftest import rows

GDP_COLUMNS = ["DATAFLOW", "LAST UPDATE", "freq", "unit", "s_adj", "na_item", "geo", "TIME_PERIOD", "GDP", "C", "I"]


def day(y, q):
    return dt.date(y, 3 * q - 2, 1)


@pytest.fixture(scope="module")
def panel(spark):
    data = [("a", 1995 * 4 + i, float(i + 1)) for i in range(8)] + [("b", 1995 * 4 + i, 10.0) for i in (0, 1, 3, 4)]
    df = spark.createDataFrame(data, "k string, quarter_idx int, v double")
    return df.withColumn("date", F.make_date((F.col("quarter_idx") / 4).cast("int"), F.col("quarter_idx") % 4 * 3 + 1, F.lit(1)))


def test_period_parsing(spark):
    df = spark.createDataFrame([("1995-Q1",), ("2024-Q4",), ("2024-4",), ("bad",), (None,)], "p string")
    got = rows(periods.with_period(df, "p"))
    assert [r["date"] for r in got] == [day(1995, 1), day(2024, 4), day(2024, 4), None, None]
    assert got[0]["quarter_idx"] == 7980
    back = rows(spark.createDataFrame([(day(2020, 2),)], "d date").select(periods.quarter_label(F.col("d")).alias("l")))
    assert back[0]["l"] == "2020-Q2"


def test_delimited_reader_drops_empty_rows(spark, tmp_path):
    lines = [";".join(GDP_COLUMNS), "x;u;Q;m;s;g;ES;1995-Q1;178588.8;136609.5;37941.9", "x;u;Q;m;s;g;ES;1995-Q2;NA;;abc"]
    (tmp_path / "a.csv").write_text("\n".join(lines + [";" * 10] * 5) + "\n")
    got = rows(io.read_delimited(spark, str(tmp_path / "a.csv"), GDP_COLUMNS, "TIME_PERIOD", ";",
                                 types={"GDP": "double", "C": "double", "I": "double"}), "TIME_PERIOD")
    assert len(got) == 2 and got[0]["GDP"] == 178588.8
    assert (got[1]["GDP"], got[1]["C"], got[1]["I"]) == (None, None, None)


def test_sdmx_reader(spark, tmp_path):
    cell = dict.fromkeys(io.SDMX_COLUMNS, "")
    body = [",".join(io.SDMX_COLUMNS)]
    for geo, sex, year, v in (("ES", "T", 1995, 27017523), ("ES", "F", 1995, 1), ("FR", "T", 1996, 5)):
        body.append(",".join(str(x) for x in {**cell, "freq": "A", "unit": "NR", "sex": sex, "geo": geo,
                                               "TIME_PERIOD": year, "OBS_VALUE": v}.values()))
    (tmp_path / "p.csv").write_text("\n".join(body) + "\n")
    got = rows(io.read_sdmx(spark, str(tmp_path / "p.csv"), {"sex": "T", "geo": ["ES", "FR"]}), "geo")
    assert [(r["geo"], r["period"], r["value"]) for r in got] == [("ES", "1995", 27017523.0), ("FR", "1996", 5.0)]


def test_table_round_trip(spark, panel, tmp_path):
    wide = panel.filter("k = 'a'").select("date", F.col("v").alias("x"), (F.col("v") * 2).alias("y"))
    io.write_table(wide, str(tmp_path / "t"), ["date", "y", "x"])
    got = io.read_observables(spark, str(tmp_path / "t"), ["y", "x"], fmt="csv")
    assert got.columns == ["date", "y", "x"] and got.count() == 8 and dict(got.dtypes)["date"] == "date"


def test_rolling_modes(panel):
    r = {(x["k"], x["quarter_idx"]): x for x in rows(series.rolling_sum(
        series.rolling_sum(panel, ["k"], "v", "rows4"), ["k"], "v", "cal4", mode="calendar"))}
    assert [r[("a", 7980 + i)]["rows4"] for i in range(5)] == [1, 3, 6, 10, 14]
    assert r[("b", 7984)]["rows4"] == 40 and r[("b", 7984)]["cal4"] == 30     # a gap at the third quarter
    lags = sum(i + 1 for i in range(4, 8))
    assert r[("a", 7987)]["rows4"] == lags
    one = rows(series.rolling_sum(panel.filter("k = 'b'"), [], "v", "s", mode="calendar", min_periods=3), "quarter_idx")
    assert [x["s"] for x in one] == [None, None, 30.0, 30.0]


def test_dlog(panel):
    got = rows(series.dlog(panel, ["k"], {"g": "v"}).filter("k = 'a'"), "quarter_idx")
    assert [x["g"] for x in got] == pytest.approx([100 * math.log((i + 2) / (i + 1)) for i in range(7)])
    bad = panel.withColumn("v", F.when(F.col("quarter_idx") == 7982, -1.0).otherwise(F.col("v")))
    nulls = rows(series.dlog(bad, ["k"], {"g": "v"}, on_nonpositive="null").filter("k = 'a'"), "quarter_idx")
    assert [x["g"] is None for x in nulls] == [False, True, True, False, False, False, False]
    with pytest.raises(Exception, match="not positive"):
        series.dlog(bad, ["k"], {"g": "v"}).collect()


def test_one_long_series_is_not_gathered(panel):
    one = panel.filter("k = 'b'").select("quarter_idx", "v", "date").withColumn("v", F.col("v") + F.col("quarter_idx"))
    got = rows(series.dlog(one, [], {"g": "v"}), "quarter_idx")
    assert [x["quarter_idx"] for x in got] == [7981, 7984]       # the quarter after the gap has no predecessor
    assert got[0]["g"] == pytest.approx(100 * math.log(7991 / 7990)) and got[0]["date"] == day(1995, 2)
    assert "SinglePartition" not in series.dlog(one, [], {"g": "v"})._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        series.signed_stack(panel, [], "quarter_idx", "v")


def test_samples_index_ticks_thin(panel):
    s = series.split_samples(panel, [("full", None, None), ("early", None, "1996-01-01")])
    info = {(r["sample"], r["k"]): r for r in rows(series.sample_info(s, ["sample", "k"]))}
    assert info[("early", "a")]["n"] == 4 and info[("full", "a")]["last_date"] == day(1996, 4)
    idx = rows(series.index_base(panel, ["k"], "v", "x").filter("k = 'a'"), "quarter_idx")
    assert [r["x"] for r in idx][:3] == [100.0, 200.0, 300.0]
    assert [r["date"] for r in rows(series.axis_ticks(panel, ["k"]).filter("k = 'a'"), "date")] == [day(1995, 1), day(1996, 1)]
    assert series.thin(panel, ["k"], 4).count() == 3
    assert series.head_by_time(panel, ["k"], 3).count() == 6


def test_signed_stack_ends_at_the_sums(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((2.0, -1.0, 3.0, -4.0))], "t int, rank int, c double")
    got = rows(series.signed_stack(df, ["t"], "rank", "c"), "rank")
    assert (got[-1]["pos_top"], got[-1]["neg_top"]) == (5.0, -5.0)
    assert (got[2]["pos_bottom"], got[3]["neg_bottom"]) == (2.0, -1.0)


def test_wide_and_long_are_inverse(panel):
    wide = series.long_to_wide(panel, ["quarter_idx"], "k", "v", ["a", "b"])
    long = series.wide_to_long(wide, ["quarter_idx"], ["a", "b"], "k", "v").filter("v is not null")
    assert sorted(map(tuple, long.select("k", "quarter_idx", "v").collect())) == \
        sorted(map(tuple, panel.select("k", "quarter_idx", "v").collect()))


def test_alignment(spark):
    a = spark.createDataFrame([("k", 1, 1.0, 5), ("k", 1, 2.0, 3), ("k", 2, 3.0, 1)], "k string, date int, x double, line int")
    first = align.first_match(a, ["k", "date"], "line")
    assert [(r["date"], r["x"]) for r in rows(first, "date")] == [(1, 2.0), (2, 3.0)]
    b = spark.createDataFrame([("k", 2, 9.0), ("k", 3, 8.0)], "k string, date int, y double")
    assert [(r["x"], r["y"]) for r in rows(align.align(first, b, on=["k", "date"]))] == [(3.0, 9.0)]
    assert rows(align.common_periods(a, b, on=["k", "date"])) == [{"k": "k", "date": 2}]
    assert rows(align.missing_keys(b, a, ["date"])) == [{"date": 3}]


def test_asof_interpolation(spark):
    annual = spark.createDataFrame([("k", 1996, 100.0), ("k", 1997, 200.0), ("k", 2000, 500.0)], "k string, year int, value double")
    dates = [day(1995, 3), day(1996, 1), day(1996, 3), day(1998, 2), day(1999, 4), day(2000, 4), day(2003, 1)]
    q = spark.createDataFrame([("k", d) for d in dates], "k string, date date")
    got = [r["interpolated"] for r in rows(align.asof_interpolate(q, annual, ["k"]), "date")]
    # the next annual row counts, whatever the distance in years
    assert got == pytest.approx([100, 100, 150, 275, 425, 500, 500])


def test_ratio_calibration(spark):
    num = spark.createDataFrame([("k", y, 20.0) for y in (1999, 2001, 2005)], "k string, year int, value double")
    den = spark.createDataFrame([("k", 2001, 100.0), ("k", 2002, 200.0), ("k", 2003, 300.0)], "k string, year int, value double")
    got = rows(series.ratio_calibration(num, den, ["k"], [2001, 2002, 2003], 2001), "date")
    assert [r["ratio"] for r in got] == pytest.approx([0.1] * 4 + [0.2] * 4 + [None] * 4)
    assert 26749 / 1174278 == pytest.approx(0.0228, abs=1e-4)


def test_labels(spark):
    df = spark.createDataFrame([("eps_x₍ₓ₎",), ("eps_xi_h₍ₓ₎",), ("eps_x",), ("eps_xq",), ("mean",)], "c string")
    got = {r["c"]: r for r in rows(df.select("c", labels.match_shock_name(F.col("c"), labels.SHOCKS).alias("m"),
                                             labels.is_component_shock(F.col("c")).alias("s")))}
    assert [got[c]["m"] for c in ("eps_x₍ₓ₎", "eps_xi_h₍ₓ₎", "eps_x", "eps_xq")] == ["eps_x", "eps_xi_h", "eps_x", None]
    assert got["mean"]["s"] is False
    assert {r["label"] for r in rows(labels.relabel(df, "c", {"mean": "Mitjana"}))} >= {"Mitjana", "eps_xq"}


def test_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "i int, x double")
    got = rows(df.select("i", numeric.or_default(F.col("x"), 9.0).alias("d"), numeric.or_null(F.col("x")).alias("n")), "i")
    assert [r["d"] for r in got] == [1.0, 9.0, 9.0] and [r["n"] for r in got] == [1.0, None, None]
    assert numeric.valid_rows(df, "x").count() == 1




def test_observables_plan(spark):
    n = 12
    qs = [(1995 + i // 4, i % 4 + 1) for i in range(n)]
    acc = spark.createDataFrame([("k", day(*q), 100.0 + i, 60.0 + i, 20.0 + i) for i, q in enumerate(qs)],
                                "geo string, date date, GDP double, C double, I double")
    nom = acc.select("geo", "date", (F.col("GDP") * 1.1).alias("GDP_nominal"))
    lab = acc.select("geo", "date", (F.col("GDP") / 2).alias("D1"))
    tax = spark.createDataFrame([("k", day(*q), 5.0 if i % 2 else -1.0, 8.0) for i, q in enumerate(qs)],
                                "geo string, date date, IS double, IRPF double")
    pop = spark.createDataFrame([("k", y, 1000.0 + 10 * y) for y in (1995, 1996, 1997)], "geo string, year int, value double")
    obs = rows(observables(level_series(acc, nom, lab, tax, pop, ["geo"]), ["geo"], on_nonpositive="null"), "date")
    assert [r["date"] for r in obs] == [day(*q) for q in qs[4:]]

    def people(i):
        y, q = qs[i]
        v = 1000.0 + 10 * y
        return v + (10 * (q - 1) / 4 if y < 1997 else 0)

    r, i = obs[0], 4
    assert r["obs_c"] == pytest.approx(100 * math.log((64 / people(4)) / (63 / people(3))))
    assert r["obs_wh"] == pytest.approx(100 * math.log((52 / 1.1 / people(4)) / (51.5 / 1.1 / people(3))))
    assert r["obs_Gc"] == pytest.approx(100 * math.log((8 / 1.1 / people(4)) / (8 / 1.1 / people(3))))


PUBLIC = ("PANEL_ACCOUNTS", "PANEL_POPULATION", "PANEL_TAXES")


@pytest.mark.skipif(any(v not in os.environ for v in PUBLIC), reason="set " + ", ".join(PUBLIC) + " to the public CSV files")
def test_public_series(spark):
    """Growth on the public quarterly accounts; nominal accounts and pay are stand-ins and not compared."""
    accounts, population, taxes = (os.environ[v] for v in PUBLIC)
    acc = periods.with_period(io.read_delimited(
        spark, accounts, GDP_COLUMNS, "TIME_PERIOD", ";",
        types={"GDP": "double", "C": "double", "I": "double"}), "TIME_PERIOD").select("geo", "date", "GDP", "C", "I")
    assert acc.count() == 124
    pop = (io.read_sdmx(spark, population, {"geo": "ES"})
           .select(F.lit("Spain").alias("geo"), F.col("period").cast("int").alias("year"), "value"))
    tax = periods.with_period(io.read_delimited(
        spark, taxes, ["period", "IS", "IRPF"], "period", types={"IS": "double", "IRPF": "double"}), "period").select(
        F.lit("Spain").alias("geo"), "date", "IS", "IRPF")
    nom = acc.select("geo", "date", F.col("GDP").alias("GDP_nominal"))
    levels = level_series(acc, nom, acc.select("geo", "date", F.col("GDP").alias("D1")), tax, pop, ["geo"])
    obs = {r["date"]: r for r in rows(observables(levels, ["geo"]))}
    assert len(obs) == 116 and sum(d < dt.date(2020, 1, 1) for d in obs) == 96
    # Published-data goldens per quarter.
    for q, c, inv in ((day(1996, 1), -0.173299, 0.654960), (day(1996, 2), 0.819125, 0.309739),
                      (day(2020, 2), -17.172344, -22.162422), (day(2024, 4), 0.391593, 3.263174)):
        assert obs[q]["obs_c"] == pytest.approx(c, abs=2e-6) and obs[q]["obs_inv"] == pytest.approx(inv, abs=2e-6)
    idx = series.index_base(series.period_filter(levels, lo="1996-01-01"), ["geo"], "lev_c", "x")
    assert rows(idx.filter("date = '2024-10-01'"))[0]["x"] == pytest.approx(143.464490, abs=2e-6)
    rolled = series.rolling_sum(tax.withColumn("quarter_idx", periods.quarter_idx(F.col("date"))), ["geo"], "IS", "s")
    assert rows(rolled.filter("date = '1996-01-01'"))[0]["s"] == pytest.approx(7366.527)


def test_columns_are_found_by_header(spark, tmp_path):
    from panelspark.sources.tables import read_delimited, read_draws, read_sdmx, write_draws
    (tmp_path / "a.csv").write_text("OBS_VALUE,Sex,geo,TIME_PERIOD,sex,freq,unit\n27,Males,ES,1995,M,A,NR\n28,Total,ES,1995,T,A,NR\n")
    got = rows(read_sdmx(spark, str(tmp_path / "a.csv"), {"sex": "T"}))
    assert got == [{"geo": "ES", "freq": "A", "unit": "NR", "period": "1995", "value": 28.0}]
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path / "a.csv"), ["geo", "absent"], "geo")
    draws = spark.createDataFrame([(r, "p", 1, k, 1.0) for r in "ab" for k in (1, 2)],
                                  "run string, param string, chain int, iter long, value double")
    for _ in range(2):
        write_draws(draws, str(tmp_path / "draws"))
    write_draws(draws.filter("run = 'a'").limit(1), str(tmp_path / "draws"))
    assert read_draws(spark, str(tmp_path / "draws"), "a").count() == 1 and read_draws(spark, str(tmp_path / "draws"), "b").count() == 2


def test_asof_over_range_ends_long_keys_and_odd_rows(spark):
    """A key with 10 000 annual rows, keys without any, null keys and dates; whatever the ranges."""
    import datetime
    import random
    rng = random.Random(2)
    years = {"long": {y: float(y % 97) for y in rng.sample(range(1, 9999), 9000)}, "one": {2001: 5.0}, "few": {1999: 1.0, 2003: 9.0, 2004: 0.0}}
    annual = [(k, y, v) for k, ys in years.items() for y, v in ys.items()] + [(None, 2000, 3.0), ("one", None, 4.0), ("few", 2000, None)]
    q = [("long", datetime.date(rng.randrange(1, 9999), rng.choice([1, 4, 7, 10]), 1), i) for i in range(4000)]
    q += [(k, datetime.date(y, m, 1), y) for k in ("one", "few", "none", None) for y in range(1997, 2008) for m in (1, 4, 10)] + [("one", None, 0)]
    df = spark.createDataFrame(q, "k string, date date, note int").repartition(7)
    known = spark.createDataFrame(annual, "k string, year int, value double").repartition(3)

    def want(k, d):
        ys = sorted(years.get(k, {})) if k is not None and d is not None else []
        at = [y for y in ys if y <= d.year] if ys else []
        if not ys:
            return None
        if not at:
            return years[k][ys[0]]
        if len(at) == len(ys):
            return years[k][ys[-1]]
        f = (d.month - 1) // 3 / 4
        return years[k][at[-1]] * (1 - f) + years[k][ys[len(at)]] * f

    for ranges in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            got = align.asof_interpolate(df, known, ["k"]).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(((r["k"], r["date"], r["note"]) for r in got), key=str) == sorted(q, key=str)
        assert all(r["interpolated"] == pytest.approx(want(r["k"], r["date"]), abs=1e-9) if want(r["k"], r["date"]) is not None
                   else r["interpolated"] is None for r in got)


def test_a_repeated_year_is_an_error(spark):
    q = spark.createDataFrame([("a", 2001)], "k string, y int").selectExpr("k", "make_date(y, 1, 1) AS date")
    annual = spark.createDataFrame([("a", 2000, 1.0), ("a", 2000, 2.0), ("b", 2000, 2.0)], "k string, year int, value double")
    with pytest.raises(Exception, match="repeats the year 2000"):
        align.asof_interpolate(q, annual, ["k"]).collect()
    # the two rows of the year in neighbouring partitions
    ends = [{"k": "a", "_part": p, "_end": e, "_v0": 1.0, "_v1": 2000.0} for p in (0, 1) for e in (1, 2)]
    with pytest.raises(ValueError, match="repeats the year 2000"):
        align._from_neighbours(ends, ["k"])


def test_repeated_dates_count_once(spark):
    acc = spark.createDataFrame([("k", day(1995 + i // 4, i % 4 + 1), 10.0 + i, 5.0, 5.0) for i in range(4)],
                                "geo string, date date, GDP double, C double, I double")
    tax = [("k", day(1995, q), v, v) for q, v in ((1, 1.0), (2, 10.0), (2, 11.0), (3, 2.0), (4, 3.0))]
    tax = spark.createDataFrame(tax, "geo string, date date, IS double, IRPF double")
    nom, lab = acc.selectExpr("geo", "date", "GDP AS GDP_nominal"), acc.selectExpr("geo", "date", "C AS D1")
    pop = spark.createDataFrame([("k", 1995, 1.0)], "geo string, year int, value double")
    got = rows(level_series(acc.union(acc), nom, lab, tax, pop.union(pop), ["geo"]), "date")
    assert [r["lev_Gc"] for r in got] == pytest.approx([1.0, 11.0, 13.0, 16.0])    # the smaller of the two counts


def test_raw_files_to_observables(spark, tmp_path):
    """Headers in different orders, unreadable and repeated periods, one plan for growth and levels."""
    quarters = [(y, q) for y in range(1995, 2000) for q in (1, 2, 3, 4)]
    label = [f"{y}-Q{q}" for y, q in quarters]
    gdp, cons, inv, nominal, pay, corp, inc = zip(*[
        (100.0 + i, 60.0 + i * i / 10, 20.0 + i, 110.0 + 2 * i, 50.0 + i, (-1.0) ** i * 3 + 5, 9.0 + i) for i in range(20)])

    def write(name, header, lines, sep=","):
        (tmp_path / name).write_text("\n".join(sep.join(map(str, x)) for x in [header, *lines]) + "\n")
        return str(tmp_path / name)

    accounts = write("a.csv", ["I", "TIME_PERIOD", "unused", "C", "geo", "GDP"],
                     [(inv[i], label[i], "x", cons[i], "Spain", gdp[i]) for i in reversed(range(20))]
                     + [(1, label[7], "x", 1, "Spain", 1), ("", "", "", "", "", ""), (1, "NA", "x", 1, "Spain", 1)], ";")
    nom = write("n.csv", ["TIME_PERIOD", "GDP"], [(label[i], nominal[i]) for i in range(20)] + [(label[3], 7)])
    labour = write("d.csv", ["OBS_VALUE", "na_item", "TIME_PERIOD"], [(pay[i], "D1", label[i]) for i in range(20)] + [(1, "D2", label[0])])
    taxes = write("t.csv", ["fecha", "IRPF_Meur", "IS_Meur"], [(label[i], inc[i], corp[i]) for i in range(20)] + [("2025-Q1", 1, 1)])
    people = write("p.csv", ["TIME_PERIOD", "OBS_VALUE"], [(y, 1000 + 10 * (y - 1995)) for y in range(1995, 2000)] + [(1995, 5)])
    growth, levels = tables_from_files(
        spark, RawFile(accounts, "TIME_PERIOD", {"GDP": "GDP", "C": "C", "I": "I"}, key="geo", sep=";"),
        RawFile(nom, "TIME_PERIOD", {"GDP_nominal": "GDP"}, constant="Spain"),
        RawFile(labour, "TIME_PERIOD", {"D1": "OBS_VALUE"}, constant="Spain", filters={"na_item": "D1"}),
        RawFile(taxes, "fecha", {"IS": "IS_Meur", "IRPF": "IRPF_Meur"}, constant="Spain"),
        RawFile(people, "TIME_PERIOD", {"value": "OBS_VALUE"}, constant="Spain"))
    pop = [1000 + 10 * (y - 1995) + (10 * (q - 1) / 4 if y < 1999 else 0) for y, q in quarters]
    deflator = [n / g for n, g in zip(nominal, gdp)]
    want = {"c": [c / p for c, p in zip(cons, pop)], "inv": [c / p for c, p in zip(inv, pop)],
            "wh": [c / f / p for c, f, p in zip(pay, deflator, pop)],
            "Gc": [sum(corp[max(0, i - 3):i + 1]) / deflator[i] / pop[i] for i in range(20)],
            "Gh": [sum(inc[max(0, i - 3):i + 1]) / deflator[i] / pop[i] for i in range(20)]}
    got, flat = rows(growth, "date"), rows(levels, "date")
    assert [r["date"] for r in got] == [r["date"] for r in flat] == [day(*q) for q in quarters[4:]]
    for name, level in want.items():
        assert [r[f"lev_{name}"] for r in flat] == pytest.approx(level[4:], rel=1e-12)
        assert [r[f"obs_{name}"] for r in got] == pytest.approx([100 * math.log(level[i] / level[i - 1]) for i in range(4, 20)], abs=1e-9)


def test_quarter_bounds_reach_the_scan(spark, tmp_path):
    days = [dt.datetime(1995, 12, 31), dt.datetime(1996, 1, 1), dt.datetime(1997, 3, 31, 23, 59), dt.datetime(1997, 4, 1)]
    for kind in ("date", "timestamp"):
        path = str(tmp_path / kind)
        spark.createDataFrame([(x,) for x in days], "d timestamp").selectExpr(f"CAST(d AS {kind}) AS d").write.parquet(path)
        df = series.quarters_between(spark.read.parquet(path), "d", "1996-02-10", "1997-05-01")
        assert df.count() == 2
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(d," in plan and "LessThan(d," in plan


def test_one_series_without_keys_in_row_mode(spark, monkeypatch):
    """Frames that reach over the ends of blocks, gaps in the order, nulls; no task holds the whole series."""
    import random
    rng = random.Random(5)
    at = sorted(rng.sample(range(10 ** 6), 500))
    values = [None if rng.random() < 0.1 else rng.uniform(-5, 5) for _ in at]
    df = spark.createDataFrame(list(zip(at, values)), "quarter_idx int, v double").repartition(6)
    for block, n in ((64, 4), (5, 4), (10, 37), (1 << 17, 1)):
        monkeypatch.setattr(series, "BLOCK_ROWS", block)
        rolled = series.rolling_sum(df, [], "v", "s", n=n, min_periods=2 if n > 1 else 1)
        got = {r["quarter_idx"]: r["s"] for r in rolled.collect()}
        assert len(got) == 500
        for i, a in enumerate(at):
            known = [v for v in values[max(0, i - n + 1):i + 1] if v is not None]
            want = sum(known) if len(known) >= (2 if n > 1 else 1) else None
            assert got[a] == (pytest.approx(want, abs=1e-9) if want is not None else None)
        if block == 64:
            windows = rolled._jdf.queryExecution().executedPlan().toString().split("Window")
            assert len(windows) > 1 and not any("SinglePartition" in w and "_place" in w.split("SinglePartition")[0] for w in windows[1:2])
    assert [r["quarter_idx"] for r in rows(series.thin(df, [], 7), "quarter_idx")] == at[::7]
    assert [r["quarter_idx"] for r in rows(series.head_by_time(df, [], 9), "quarter_idx")] == at[:9]
    whole = df.filter("v IS NOT NULL")
    first = next(v for v in values if v is not None)
    got = {r["quarter_idx"]: r["x"] for r in series.index_base(whole, [], "v", "x").collect()}
    assert all(got[a] == pytest.approx(100 * v / first) for a, v in zip(at, values) if v is not None)


def test_ticks_of_one_series(spark):
    days = [day(y, q) for y in range(1995, 2005) for q in (1, 2, 3, 4)]
    df = spark.createDataFrame([(x,) for x in days], "date date")
    assert [r["tick"] for r in rows(series.axis_ticks(df, []), "date")] == ["1995", "1996", "2000", "2004"]
