"""Float choices, the boundary, seeds, routes and the whole build on small tables."""


from strandline.plans import build, quality_queries, records, rules

FLOAT = "k int, shares double, price double, full_cap double, factor_bse double, implied_nse double, rupees_nse double"


def floats(spark, *rows):
    return {r.k: r for r in records.with_float(spark.createDataFrame(rows, FLOAT)).collect()}


def test_float_choice_tells_rule_gap_basis_and_source(spark):
    got = floats(
        spark,
        (1, 100.0, 10.0, 1000.0, 0.5, 51.0, None),  # 2 % apart is within
        (2, 100.0, 10.0, 1000.0, 0.5, 52.0, None),
        (3, 100.0, 10.0, 1000.0, 0.5, None, 9.0),
        (4, 100.0, 10.0, 1000.0, None, 40.0, 9.0),
        (5, None, 10.0, None, None, 40.0, 777.6),
        (6, 100.0, None, 1000.0, 0.5, None, None),
        (7, 100.0, 10.0, 1000.0, None, 103.0, None),  # no factor above 1.02
        (8, 100.0, 10.0, 1000.0, 0.0, 50.0, None),
        (9, None, None, None, 0.5, None, 50.0),
        (10, 100.0, 10.0, None, None, None, 0.0),
    )
    say = lambda k: (got[k].choice.rule if got[k].choice else None, got[k].gap_pct, got[k].factor, got[k].ff, got[k].basis, got[k].source)
    assert say(1) == ("bse-primary", 2.0, 0.5, 500.0, "factor x shares x price", "bse")
    assert say(2) == ("nse-preferred-on-material-gap", 4.0, 0.52, 520.0, "factor x shares x price", "nse") and "4.000 %" in got[2].choice.why and "beyond 2 %" in got[2].choice.why
    assert say(3) == ("bse-only", None, 0.5, 500.0, "factor x shares x price", "bse") and say(4)[:4] == ("nse-only", None, 0.4, 400.0)
    assert say(5) == ("nse-only-published-rupees", None, None, 778.0, "published rupees of the second exchange", "nse")
    assert say(6) == ("bse-only", None, 0.5, 500.0, "factor x full value", "bse") and say(7) == (None,) * 6
    assert say(8)[:3] == ("bse-primary", None, 0.0) and "unknown" in got[8].choice.why
    assert say(9) == ("bse-only", None, 0.5, 50.0, "published rupees of the second exchange", "nse") and say(10) == (None,) * 6
    assert all((r.ff is None) == (r.basis is None) for r in got.values())


def test_boundary_of_few_companies_and_of_none(spark):
    rows = [(1, "a", "standard", 50.0), (2, "b", "standard", 90.0), (3, "c", "smallcap", 60.0), (4, "d", "smallcap", 20.0), (5, "e", "outside", 55.0), (6, "f", "outside", None), (7, "g", "outside", 95.0)]
    df = spark.createDataFrame(rows, "k int, name string, segment string, ff double")
    r = records.boundary_record(df, "k", "name").first()
    assert (r.standard_floor, r.standard_floor_company, r.smallcap_ceiling, r.smallcap_ceiling_company) == (50.0, "a", 60.0, "c")
    assert (r.has_overlap, r.overlap_width, r.overlap_ratio, r.n_overlap, r.n_overlap_standard, r.n_overlap_smallcap, r.n_overlap_outside) == (True, 10.0, 1.2, 3, 1, 1, 1)
    assert (r.rank_cutoff, r.rank_cutoff_company, r.standard_p5, r.standard_median, r.smallcap_median, r.outside_median) == (90.0, "b", 50.0, 90.0, 60.0, 95.0)
    apart = records.boundary_record(df.filter("k <> 3"), "k", "name").first()
    assert (apart.has_overlap, apart.overlap_low, apart.n_overlap, apart.smallcap_ceiling) == (False, None, 0, 20.0)
    none = records.boundary_record(df.limit(0), "k", "name").first()
    assert (none.n_standard, none.standard_floor, none.rank_cutoff, none.has_overlap) == (0, None, None, False)


def test_seed_rows_are_appended_with_a_reason_or_put_aside(spark):
    have = spark.createDataFrame([("I1",), ("bse:9",)], "key string")
    seed = spark.createDataFrame([(1, "I1", "there", "S", "1", 1.0), (2, "I2", "other exchange", "S2", None, 2.0), (3, "I3", "nowhere", " ", "", 3.0), (4, None, "by code", None, "8", 4.0), (5, None, "by code, there", None, "9", 5.0), (6, None, "nothing", "S6", None, 6.0), (7, "I2", "again", "S7", None, 7.0)], "ord int, isin string, name string, symbol string, scrip_code string, cap double")
    fresh, side = records.split_seed(seed, have)
    assert [(r.isin, r.name, r.cap) for r in side.collect()] == [("I3", "nowhere", 3.0)]
    every = {r.key: (r.name, r.seed_code, r.no_scrip_reason) for r in records.appended(have, fresh).collect()}
    assert set(every) == {"I1", "bse:9", "I2", "bse:8"} and every["I2"] == ("other exchange", None, "listed on the other exchange alone") and "code 8" in every["bse:8"][2]


def test_instruments_and_fetches_are_routed_with_reasons(spark):
    rows = spark.createDataFrame([("1", "A", "A", "INE000000001"), (" 2 ", "B", "IF", "bad"), ("3", "C", "F", None), ("4", " ", "A", None), (None, "D", "A", None), ("5", "E", None, None)], "scrip_code string, scrip_id string, group string, isin string")
    got = {r.scrip_code: (r.route, r.kind, r.isin, r.reason) for r in records.instrument_route(rows, spark.createDataFrame([("1",), ("4",), ("1",)], "scrip_code string")).collect()}
    assert got["1"] == ("kept", "equity", "INE000000001", None) and got["2"] == ("kept", "trust", None, None)
    assert got["3"][3] == "neither equity nor a trust, group F" and got["5"][3] == "neither equity nor a trust, group none" and got["4"][3] == got[""][3] == "no scrip code or no scrip id"
    master = spark.createDataFrame([("1", "I1", 5.0), ("2", "I2", 50.0), ("3", "I3", None), ("4", "I4", 1.0)], "scrip_code string, isin string, indicative_cap double")
    held, seed = spark.createDataFrame([("1",), (None,), ("99",)], "scrip_code string"), spark.createDataFrame([(1, "4", "I4"), (2, "3", "wrong"), (3, "77", "I7"), (4, "2", "I2")], "ord int, scrip_code string, isin string")
    out = {(r.scrip_code, r.route, r.reason) for r in records.universe_to_fetch(master, held, seed, 10.0).collect()}
    assert out == {("1", "fetch", "held"), ("2", "fetch", "large"), ("4", "fetch", "seeded"), ("3", "rejected", "the master has ISIN I3"), ("77", "rejected", "not in the active master")}


def test_disagreements_and_rules_of_several_rows(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, -3.0), (3, 2.5), (4, None), (5, 0.5)], "k int, gap double")
    one, top = records.disagreements(rows, "k", "gap", 2.0, 2)
    assert tuple(one.first()) == (4, 1.75, 2, 2, -3.0) and [(r.k, r.gap) for r in top.collect()] == [(2, -3.0), (3, 2.5)]
    assert tuple(records.disagreements(rows.limit(0), "k", "gap", 2.0)[0].first()) == (0, None, 0, None, None)
    holdings = spark.createDataFrame([("a", "I"), ("a", "I"), ("b", "I"), ("a", None), ("a", None)], "fund string, isin string")
    assert [tuple(r) for r in rules.fund_collisions(holdings).collect()] == [("a", "I", 2)] * 2
    drift = spark.createDataFrame([(1, False), (2, True), (3, None)], "k int, requires_trade boolean")
    assert {r.key for r in rules.trade_claims(drift, "k").collect()} == {"2", "3"}
    sizes = spark.createDataFrame([(1, 3e10), (2, 1e10)], "k int, size double")
    units = rules.unit_problems(spark.createDataFrame([(1, 5e4, None), (2, 1.0, 1.0)], "k int, a double, b double"), sizes, "k", ["a", "b"])
    assert [tuple(r) for r in units.collect()] == [("rupees-of-the-large", "1", "a=50000")]


def test_build_of_companies_from_empty_and_shuffled_sources(spark):
    s = build_sources(spark)
    got = {r.key: r for r in build.company_records(s).collect()}
    assert set(got) == {"I1", "I2", "I3", "bse:4", "I5"}
    a = got["I1"]
    assert (a.name, a.scrip_code, a.symbol, a.held, a.eem.weight_pct, a.smin, a.segment, a.sector, a.sector_source) == ("One Ltd", "1", "S1", True, 2.0, None, "standard", "Power", "scrips")
    assert (a.price, a.prev_close, a.price_tier, a.stale_days, a.day_change_pct, a.adv, a.adv_source, a.ff, a.choice.rule) == (12.0, 10.0, "eod", 0, 20.0, 7.0, "batch-3m", 600.0, "bse-only")
    assert a.quarantined and a.verdict == "unknown" and a.quarantine.reason == "the share count could not be corroborated"
    b, c, d, e = got["I2"], got["I3"], got["bse:4"], got["I5"]
    assert (b.held, b.via, b.symbol_source, b.price_tier, b.stale_days) == (False, "scrips", "universe", "stale", 3)
    assert (c.held, c.scrip_code, c.no_scrip_reason, c.ff, c.source, c.segment) == (True, None, build.NO_SCRIP, 90.0, "nse", "smallcap") and (d.via, d.symbol, d.price) == ("scrips", None, None)
    assert (e.via, e.symbol_source, e.sector, e.sector_source, e.verdict) == ("seed", "seed", "Steel", "seed", "unknown")
    empty = build.Sources(**{n: df.limit(0) for n, df in vars(s).items()})
    assert build.company_records(empty).count() == 0


def build_sources(spark):
    f = spark.createDataFrame
    return build.Sources(
        f([(2, "eem", "I1", "1", "S1", "universe", "later", 2.0, 1.0, 1.0), (1, "eem", "I1", "1", "S1", "universe", "first", 1.0, 1.0, 1.0), (3, "smin", "I3", None, "S3", "seed", "Three", 1.0, 1.0, 1.0), (4, "smin", None, None, None, None, "lost", 1.0, 1.0, 1.0)], "ord int, fund string, isin string, scrip_code string, symbol string, symbol_source string, name string, weight_pct double, quantity double, value_usd double"),
        f([(1, "1", "I1", "One Ltd", "Power", "equity", 1000.0, 10.0, 100.0, 0.5), (2, "2", "I2", "Two", None, "equity", 500.0, 5.0, 100.0, 0.1), (3, "4", None, "Four", None, "trust", None, None, None, None)], "ord int, scrip_code string, isin string, name string, sector string, kind string, full_cap double, price double, shares double, factor double"),
        f([("I2", "S2", "universe")], "isin string, symbol string, symbol_source string"),
        f([(1, "I5", "Five", "S5", None, 1.0, "Steel"), (2, "I6", "Six", None, None, 1.0, None), (3, "I1", "One", None, "1", 1.0, None)], "ord int, isin string, name string, symbol string, scrip_code string, cap double, sector string"),
        f([(1, "S3", None, 90.0)], "ord int, symbol string, implied_shares double, rupees double"),
        f([(1, "1", 12.0, 10.0, 0, None), (2, "2", 6.0, 6.0, 3, None)], "ord int, scrip_code string, close double, prev_close double, stale_days int, trade_date date"),
        f([(1, "S1", None, 7.0, 9.0)], "ord int, symbol string, detail_3m double, batch_3m double, batch_10d double"),
        f([("I1", None, 12.0)], "isin string, cause string, gap_pct double"),
    )


def test_every_rule_of_the_company_model_fires_in_a_query(spark):
    texts = " ".join(quality_queries.SQL[n] for n in ("dq_violations", "dq_details"))
    assert all(f"'{name}'" in texts for name in rules.company_rules())
