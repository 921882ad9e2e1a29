"""Rules that pinned cases of the change-history semantics fix."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronolake import schema
from chronolake.functions import dialect, images, keys
from chronolake.operators import compare, deltas, fold, merge, ordering, recover
from chronolake.operators.predicates import ChangeFilter
from chronolake.plans import coverage, screen, timetravel
from chronolake.sources import changelog, dumps, writers
from chronolake.streaming import changes as stream

H = datetime(2026, 5, 4, 10)
hour = lambda n: datetime(2026, 5, 4, n)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


# --- coverage


@pytest.mark.parametrize(
    "live, archived, last, no_archive, gaps, ranges, skip",
    [
        ({10, 11, 12}, set(), 13, False, [], 1, False),
        (set(), {10, 11, 12}, 13, False, [], 0, True),
        ({12, 13}, {10, 11}, 14, False, [], 1, False),
        ({10}, {13}, 14, False, [11, 12], 1, False),
        ({10, 11}, {10, 11}, 12, False, [], 1, False),
        (set(), {10, 11, 12}, 13, True, [10, 11, 12], 0, False),
        (set(), set(), 13, False, [10, 11, 12], 0, False),
    ],
)
def test_plan(live, archived, last, no_archive, gaps, ranges, skip):
    plan = coverage.build_plan({hour(h) for h in live}, {hour(h) for h in archived}, hour(10), hour(last), no_archive)
    assert [g.hour for g in plan.gaps] == gaps and len(plan.live_ranges) == ranges and plan.skip_live == skip


def test_plan_bounds_and_strictness():
    assert coverage.build_plan({H}, set(), None, hour(12)) is None
    with pytest.raises(coverage.GapError):
        coverage.build_plan(set(), set(), hour(10), hour(12), strict=True)
    assert coverage.build_plan({hour(12), hour(13)}, {hour(10), hour(11)}, hour(10), hour(14)).live_ranges == [(hour(12), hour(14))]


def test_content_hours():
    label, first = datetime(2026, 5, 4, 1), datetime(2026, 5, 3, 22, 10)
    assert sorted(h.hour for h in coverage.content_hours(label, first, label)) == [0, 1, 22, 23]
    for odd in ((None, None), (label, first), (first - timedelta(days=400), label)):
        assert coverage.content_hours(label, *odd) == {label}


def test_archive_elision():
    assert not coverage.top_n_needs_archives(True, True, True, True)
    assert all(coverage.top_n_needs_archives(*a) for a in [(False, True, True, True), (True, False, True, True), (True, True, False, True), (True, True, True, False)])
    assert not coverage.per_pk_needs_archives(["1", "2"], {"1": 2, "2": 3}, 2)
    assert coverage.per_pk_needs_archives(["1", "2"], {"1": 2}, 2) and coverage.per_pk_needs_archives([""], {"": 9}, 2) and coverage.per_pk_needs_archives(["1"], {"1": 2}, 2, other_spellings=True)


# --- keys and images


@pytest.mark.parametrize("parts", [["1"], ["a", "b"], ["", ""], ["a|b", "c"], ["a\\", "b"], ["\\|", "|", ""], ["x\\\\|"]])
def test_key_text_round_trip(spark, parts):
    df = spark.createDataFrame([(parts,)], "p array<string>")
    got = df.select(keys.split(keys.join(*[F.col("p")[i] for i in range(len(parts))])).alias("x")).first().x
    assert got == parts


def test_canonical_integers(spark):
    cases = {"7": True, "0": True, "-3": True, "007": False, "+5": False, "2.00": False, "1e1": False, "": False, "18446744073709551615": True, "-0": False}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "k string")
    assert {r.k: r.x for r in df.select("k", keys.is_canonical_integer(F.col("k")).alias("x")).collect()} == cases | {None: False}
    assert {r.k for r in df.where(keys.in_range(F.col("k"), 0, 2**64)).collect()} == {"7", "0", "18446744073709551615"}


def test_spelling_of_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"\xff\x01"),)], "b binary")
    assert [r.x for r in df.select(keys.spelled(F.col("b")).alias("x")).collect()] == ["abc", "0xFF01"]


def test_images_tell_null_absent_and_value(spark):
    df = spark.createDataFrame([('{"a":null,"n":12345678901234567890}',), ('{"b":1}',), ('{"a":"x"}',), (None,)], "i string")
    got = df.select(images.is_json_null(F.col("i"), "a").alias("null"), images.text(F.col("i"), "a").alias("text"), images.text(F.col("i"), "n").alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, None, "12345678901234567890"), (False, None, None), (False, "x", None), (False, None, None)]
    with pytest.raises(ValueError):
        images.text(F.col("i"), "a'; drop")


# --- merging


CHANGE = "event_id long, event_timestamp timestamp_ntz, binlog_file string, start_pos long, gtid string, event_type int, pk_values string, row_before string, row_after string"


def change(i, at, pk="1", kind=2, file="binlog.000001", pos=None, after=None, before=None, gtid=None):
    return (i, H + timedelta(seconds=at), file, i * 100 if pos is None else pos, gtid, kind, pk, before, after if after is not None or kind == 3 else f'{{"v":{i}}}')


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGE)


def test_first_source_wins(spark):
    a, b = changes(spark, change(1, 0, after="live")), changes(spark, change(1, 0, after="old"), change(2, 1))
    assert {(r.event_id, r.row_after) for r in merge.dedup([a, b]).collect()} == {(1, "live"), (2, '{"v":2}')}
    found = merge.divergence([a, b], ["row_after", "gtid"]).collect()
    assert [(r.event_id, r.copies, r.diverges) for r in found] == [(1, 2, True)]


def test_empty_keys_are_never_grouped(spark):
    df = changes(spark, *[change(i, i, pk="") for i in range(4)], *[change(i, i, pk="k") for i in range(10, 14)])
    assert sorted(r.event_id for r in merge.limit_per_pk(df, 1).collect()) == [0, 1, 2, 3, 13]


def test_commit_order_beats_statement_time(spark):
    """B starts first but commits last: its position says so."""
    b, a = change(2, 0, pos=900, after="B"), change(1, 2, pos=400, after="A")
    df = changes(spark, a, b)
    assert [r.row_after for r in merge.latest_per_pk(df, 1).collect()] == ["B"]
    assert ordering.order_proof(df, ["pk_values"]).first().decision == "sorted"
    assert fold.state_at(df, by_position=True).first().row_after == "B"
    assert fold.state_at(df).first().row_after == "A"


@pytest.mark.parametrize(
    "rows, proven, decision",
    [
        ([change(1, 0), change(2, 1)], True, "agrees"),
        ([change(1, 0, file=None), change(2, 1)], True, "no_coordinate"),
        ([change(1, 0, file="a.000001"), change(2, 1, file="b.000001")], True, "several_base_names"),
        ([change(1, 0), change(2, 1)], False, "ids_unproven"),
        ([change(1, 0, pos=900), change(2, 1, pos=100)], True, "renumbered"),
        ([change(1, 0, file="0/1A"), change(2, 1, file="0/1B")], True, "postgres"),
    ],
)
def test_order_decisions(spark, rows, proven, decision):
    assert ordering.order_proof(changes(spark, *rows), ["pk_values"], proven).first().decision == decision


def test_longer_file_names_come_later(spark):
    df = changes(spark, change(1, 0, file="binlog.1000000", pos=4, after="new"), change(2, 0, file="binlog.999999", pos=900, after="old"))
    assert fold.state_at(df, by_position=True).first().row_after == "new"


# --- folding


def test_row_state_over_time(spark):
    df = changes(spark, change(1, 0, kind=1, after="a"), change(2, 7200, after="b"), change(3, 14400, kind=3))
    at = lambda s: [r.row_after for r in fold.state_at(df, H + timedelta(seconds=s)).collect()]
    assert (at(-1), at(0), at(7200), at(14399), at(14400)) == ([], ["a"], ["b"], ["b"], [])
    assert [r.state for r in fold.history(df, "1").orderBy("step").collect()] == ["a", "b", None]


@pytest.mark.parametrize(
    "rows, alive",
    [
        ([("1", 2, "2"), ("2", 3, None)], set()),
        ([("1", 2, "2"), ("2", 2, None)], {"2"}),
        ([("1", 2, "2"), ("1", 1, None)], {"1", "2"}),
    ],
)
def test_key_changes(spark, rows, alive):
    df = spark.createDataFrame([change(i, i, pk=pk, kind=kind) + (moved,) for i, (pk, kind, moved) in enumerate(rows)], CHANGE + ", key_after string")
    assert {r.pk_values for r in fold.state_at(fold.split_key_changes(df, F.col("key_after"))).collect()} == alive


def test_partial_transactions_are_trimmed(spark):
    df = changes(spark, change(1, 0, gtid="a"), change(2, 5, gtid="b"), change(3, 9, gtid="b"), change(4, 20, gtid="c"))
    ids = lambda s: sorted(r.event_id for r in fold.trim_partial_transaction(df, H + timedelta(seconds=s)).collect())
    assert (ids(6), ids(9), ids(30)) == ([1], [1, 2, 3], [1, 2, 3, 4])


def test_random_log_folds_like_a_loop(spark):
    """A seeded random workload over hot and cold keys: the table as a loop over the log leaves it, at several instants."""
    rng, rows, state, want = random.Random(11), [], {}, {}
    keys_ = [str(k) for k in range(30)]
    for i in range(600):
        pk = rng.choice(keys_[:2] if rng.random() < 0.4 else keys_)
        kind = 1 if pk not in state else rng.choices((2, 3), (70, 30))[0]
        after = None if kind == 3 else f'{{"v":{i}}}'
        rows.append(change(i, i // 3, pk=pk, kind=kind, after=after, before=state.get(pk)))
        if kind == 3:
            state.pop(pk)
        else:
            state[pk] = after
        want[i // 3] = dict(state)
    df = changes(spark, *rows).repartition(5)
    for s in (0, 57, 130, 199):
        assert {r.pk_values: r.row_after for r in fold.state_at(df, H + timedelta(seconds=s)).collect()} == want[s]
    base = spark.createDataFrame(list(want[57].items()) or [("x", "y")], "pk_values string, row_after string")
    later = df.where(F.col("event_timestamp") > F.lit(H + timedelta(seconds=57)).cast("timestamp_ntz"))
    assert {r.pk_values: r.row_after for r in fold.snapshot_at(base, later).collect()} == want[199]
    assert recover.chain_check(df).count() == 0


# --- deltas, recovery, comparison


def test_positions_come_from_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/base")
    base = deltas.with_positions(spark.read.parquet(f"{tmp_path}/base"))
    dead = base.where("id % 10 = 0").select("base_file", "row_index")
    ups = spark.createDataFrame([(10, 0, False), (10, 1, True), (500, 0, False)], "id long, seq int, deleted boolean")
    got = deltas.chain_state(base, dead, ups, ["id"], ["base_file", "row_index"])
    assert sorted(r.id for r in got.collect()) == sorted([i for i in range(100) if i % 10] + [500])


def test_reversal_is_safe_text(spark):
    df = changes(spark, change(1, 0, kind=1, after='{"a":"it\'s\\nx","b":null}'), change(2, 1, kind=3, before='{"a":"q","b":"1"}'))
    got = [r.statement for r in recover.reversal_sql(df, ["a", "b"], "t`x").collect()]
    assert got == ["INSERT INTO `t``x` (`a`, `b`) VALUES ('q', '1');", "DELETE FROM `t``x` WHERE `a` = 'it''s\\nx' AND `b` IS NULL;"]
    assert recover.comment("a\nDROP TABLE x") == "-- a DROP TABLE x"
    marked = changes(spark, change(1, 0, kind=3, before='{"a":{"%s":true}}' % images.UNCHANGED))
    with pytest.raises(Exception, match="not captured"):
        recover.reversal_sql(marked, ["a"], "t").collect()


def test_cascades(spark):
    edges = spark.createDataFrame([("a", "b", "CASCADE", "RESTRICT"), ("b", "c", "RESTRICT", "RESTRICT"), ("c", "d", "CASCADE", "RESTRICT"), ("b", "a", "CASCADE", "RESTRICT"), ("b", "e", "RESTRICT", "CASCADE"), ("e", "f", "SET NULL", "RESTRICT")], "parent string, child string, delete_rule string, update_rule string")
    assert {(r.parent, r.child) for r in recover.affected_tables(edges, "a").collect()} == {("a", "b"), ("b", "c"), ("b", "a"), ("b", "e"), ("e", "f")}
    parents, children = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(5, 1), (6, 2), (7, None)], "id long, pid long")
    assert [(r.id, r.action) for r in recover.cascade_victims(parents, children, "id", "pid", "SET NULL").collect()] == [(5, "restore_key")]
    assert recover.cascade_victims(parents, children, "id", "pid", "RESTRICT").count() == 0
    df = spark.createDataFrame([(None, ""), ("a", "a"), (None, None)], "x string, y string")
    assert [r.m for r in df.select(recover.key_moved(F.col("x"), F.col("y")).alias("m")).collect()] == [True, False, False]
    script = recover.cascade_script(spark.createDataFrame([("p",)], "statement string"), spark.createDataFrame([("c",)], "statement string"))
    assert [r.statement for r in script.orderBy("step").collect()] == ["SET FOREIGN_KEY_CHECKS = 0;", "p", "c", "SET FOREIGN_KEY_CHECKS = 1;"]


def test_digests(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i long, s string")
    assert compare.verdict(a, a.orderBy(F.desc("i"))) == "EQUAL"
    assert compare.verdict(a, a.distinct()) == "DIFFERENT(rows)"
    assert compare.verdict(a, a.fillna("", ["s"])) == "DIFFERENT(values)"
    assert compare.verdict(a, a.select("i")) == "DIFFERENT(columns)"
    assert [tuple(r) for r in compare.multiset_difference(a, a.distinct()).collect()] == [(2, None, 1, 0)]


# --- sources and sinks


def test_archive_round_trip(spark, tmp_path):
    df = changes(spark, *[change(i, i * 1800) for i in range(10)])
    figures = writers.write_archive(df, f"{tmp_path}/a", "s1")
    assert sum(r.rows for r in figures.collect()) == 10 and figures.count() == 5
    wanted = ChangeFilter(since=H + timedelta(hours=1), until=H + timedelta(hours=2))
    read = changelog.archive(spark, f"{tmp_path}/a", wanted, ["s1"])
    assert sorted(r.event_id for r in read.collect()) == [2, 3, 4]
    assert "PartitionFilters: [" in (plan := read._jdf.queryExecution().toString()) and "event_date" in plan.split("PartitionFilters")[-1].split("PushedFilters")[0]
    assert writers.restore(spark, f"{tmp_path}/a", df.columns).count() == 10
    assert changelog.archive(spark, f"{tmp_path}/a", sources=["other"]).count() == 0


def test_baseline_is_verified(spark, tmp_path):
    table = spark.createDataFrame([(2, "b"), (1, "a")], "z long, a string")
    writers.write_baseline(table, f"{tmp_path}/b", {"file": "binlog.1", "pos": 4})
    assert writers.verified_baseline(spark, f"{tmp_path}/b").columns == ["a", "z"]
    table.limit(1).write.mode("append").parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError):
        writers.verified_baseline(spark, f"{tmp_path}/b")


def test_reconcile_refuses_an_empty_scan(spark):
    registry = spark.createDataFrame([("p", "s", 1)], "partition_name string, source_id string, rows long")
    with pytest.raises(ValueError):
        writers.reconcile(registry, registry.limit(0))


def test_dump_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(1, "it's \\ fine", None), (2, "a,b)(", 2.5)], "i long, s string, d double")
    writers.dump_rows(table, "t").write.text(f"{tmp_path}/d")
    assert sorted(map(tuple, dumps.read_sql(spark, f"{tmp_path}/d", ["i", "s", "d"]).collect())) == [("1", "it's \\ fine", None), ("2", "a,b)(", "2.5")]
    (tmp_path / "t.tsv").write_text("1\tx\n2\t\\N\n")
    assert sorted(map(tuple, dumps.read_tab(spark, str(tmp_path / "t.tsv"), ["i", "s"]).collect())) == [("1", "x"), ("2", None)]
    assert writers.dump_rows(table, "t", "postgres").first().line.startswith('INSERT INTO "t" ("i", "s", "d") VALUES (1, ')


def test_types():
    assert schema.column_type("int(11) unsigned").simpleString() == "bigint" and schema.column_type("bigint unsigned").simpleString() == "decimal(20,0)"
    assert schema.column_type("decimal(12,2)").simpleString() == "decimal(12,2)" and schema.column_type("decimal(65,2)").simpleString() == "string"
    assert schema.column_type("bit(8)").simpleString() == "binary" and schema.column_type("datetime(6)").simpleString() == "timestamp_ntz"
    with pytest.raises(ValueError):
        schema.column_type("hologram")


# --- statements


NOW = datetime(2026, 5, 4, 18, 0, 30)


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT * FROM _flashback.orders AS OF '2026-05-04 12:00:00' WHERE id = 42", timetravel.Travel("flashback", "orders", hour(12), None, "42")),
        ("select sku, qty from _snapshot.`orders` as of '5 minutes ago' limit 3;", timetravel.Travel("snapshot", "orders", datetime(2026, 5, 4, 17, 55, 30), None, None, ("sku", "qty"), 3)),
        ("SELECT * FROM _diff.orders BETWEEN '2 hours ago' AND 'now' WHERE id='a''b'", timetravel.Travel("diff", "orders", NOW, datetime(2026, 5, 4, 16, 0, 30), "a'b")),
        ("SELECT * FROM _flashback.t WHERE id = 7 AS OF '2026-05-04T10:00:00Z'", timetravel.Travel("flashback", "t", hour(10), None, "7")),
        ("SELECT /*+ TRAVEL_AT='2026-05-04 10:00:00' */ * FROM orders WHERE id = 1", timetravel.Travel("snapshot", "orders", hour(10), None, "1")),
        ("SELECT * FROM orders", None),
    ],
)
def test_time_travel_statements(text, want):
    assert timetravel.parse(text, NOW) == want


def test_statement_screens():
    assert screen.kind("/* x */ SELECT 1") == "read" and screen.kind("with a as (select 1) delete from t") == "write" and screen.kind("SET x = 1") == "other"
    assert screen.read_only("SELECT 'a;b' ;")
    for bad in ("SELECT 1; DROP TABLE t", "UPDATE t SET a = 1", "SELECT * FROM t FOR UPDATE", "SELECT @x", "SELECT 1 INTO OUTFILE 'x'"):
        with pytest.raises(dialect.Refused):
            screen.read_only(bad)
    assert screen.veto("SELECT group_concat(a) FROM t") and screen.veto("SELECT a FROM t UNION SELECT b FROM u") and screen.veto("SELECT a DIV 2") and screen.veto("SELECT a || b")
    assert screen.veto("SELECT a FROM t UNION ALL SELECT b FROM u") is None and screen.veto("SELECT 'UNION' FROM t") is None
    assert screen.limit_form("SELECT a FROM t LIMIT 5, 10") == "SELECT a FROM t LIMIT 10 OFFSET 5"
    assert screen.statement_fingerprint("select a from t where b in (1, 2,3)") == screen.statement_fingerprint("SELECT a  FROM t WHERE b IN (9)")
    assert screen.route(60_000, 5) == "copy" and screen.route(10, 5) == "source"


# --- functions


def test_exact_arithmetic(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    row = df.agg(dialect.exact_average(F.col("x")).alias("a"), dialect.exact_average(F.col("x"), distinct=True).alias("d")).first()
    assert (str(row.a), str(row.d)) == ("1.6667", "1.5000")
    assert df.limit(0).agg(dialect.exact_average(F.col("x")).alias("a")).first().a is None
    for n, d, s, want in ((31249996, 1000000000, 4, "0.0312"), (-5, 2, 0, "-3"), (5, 2, 0, "3"), (1, 3, 4, "0.3333"), (-1, 8, 2, "-0.13")):
        assert str(one(spark, dialect.ratio(F.lit(n), F.lit(d), s))) == want
    assert one(spark, dialect.ratio(F.lit(1), F.lit(0), 2)) is None


@pytest.mark.parametrize("unit, a, b, want", [("MONTH", "2024-01-31", "2024-02-28", 0), ("MONTH", "2024-01-31", "2024-03-01", 1), ("MONTH", "2024-03-01", "2024-01-31", -1), ("YEAR", "2024-02-29", "2025-02-28", 0), ("DAY", "2024-01-02 00:00:00", "2024-01-01 12:00:00", 0), ("HOUR", "2024-01-01 00:00:00", "2024-01-01 23:59:59", 23), ("SECOND", "2024-01-01 00:00:10", "2024-01-01 00:00:00", -10)])
def test_timestampdiff(spark, unit, a, b, want):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    assert one(spark, dialect.timestampdiff(unit, t(a), t(b))) == want


def test_other_functions(spark):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    assert one(spark, dialect.date_format(t("2024-03-05 06:07:08"), "%Y/%m/%d at %H:%i:%s")) == "2024/03/05 at 06:07:08"
    with pytest.raises(dialect.Refused):
        dialect.date_format(t("2024-03-05"), "%U")
    assert one(spark, dialect.date_add_months(t("2024-03-31"), -1)) == datetime(2024, 2, 29)
    assert one(spark, dialect.least(F.lit(1), F.lit(None).cast("int"))) is None and one(spark, dialect.greatest(F.lit(1), F.lit(3))) == 3
    assert one(spark, dialect.unix_timestamp(t("1960-01-01"))) is None and one(spark, dialect.from_unixtime(F.lit(86400))) == datetime(1970, 1, 2)
    with pytest.raises(dialect.Refused):
        dialect.substring(F.lit("a"), 0)


# --- streams


def test_whole_transactions_only(spark):
    row = lambda i, g: Row(event_id=i, gtid=g)
    held, arrived = spark.createDataFrame([row(1, "a")], "event_id long, gtid string"), spark.createDataFrame([row(2, "a"), row(3, "b"), row(4, None)], "event_id long, gtid string")
    shown, left = stream.whole_transactions(held, arrived, spark.createDataFrame([("a",)], "gtid string"))
    assert sorted(r.event_id for r in shown.collect()) == [1, 2, 4] and [r.event_id for r in left.collect()] == [3]


def test_tail_is_idempotent(spark):
    cols = "pk_values string, event_id long, event_timestamp timestamp_ntz, event_type int"
    tail = spark.createDataFrame([("a", 1, H, 1)], cols)
    batch = spark.createDataFrame([("a", 2, H + timedelta(seconds=1), 2), ("b", 3, H, 1)], cols)
    once = stream.upsert_tail(tail, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, stream.upsert_tail(once, batch).collect()))
    assert [r.pk_values for r in stream.prune_tail(once, H).collect()] == ["a"]


def test_screened_and_late(spark):
    good, bad = stream.screened(changes(spark, change(1, 0), change(2, 0, kind=9), (None, H, None, 1, None, 1, "1", None, "x"), (5, H, None, 1, None, 1, "1", None, None)))
    assert [r.event_id for r in good.collect()] == [1] and sorted(r.reason for r in bad.collect()) == ["no_id", "no_image", "unknown_kind"]
    on_time, late = stream.on_time(changes(spark, change(1, 0), change(2, 60)), H + timedelta(seconds=30))
    assert on_time.count() == late.count() == 1
    lags = spark.sql("select timestamp '2024-01-01 00:00:05Z' as read_at, 1704067200000000L as commit_ts_us union all select null, 5L")
    assert stream.lag_figures(lags).first().max_lag_s == 5.0


def test_stream_windows_and_dedup(spark, tmp_path):
    rows = [(i, H + timedelta(minutes=10 * i), "view" if i % 2 else "click", str(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows + rows[:3], "event_id long, event_time timestamp, event_type string, pk_values string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: stream.read(spark, f"{tmp_path}/in", df.schema)
    for name, out in (("once", stream.exactly_once(read())), ("windows", stream.windows(read(), "1 hour")), ("sessions", stream.sessions(read(), "15 minutes"))):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("once").count() == 12
    assert spark.table("windows").count() >= 2 and spark.table("sessions").count() > 0


def test_images_keep_kinds_and_digits(spark):
    text = '{"a":12345678901234567890.125,"b":1,"c":true,"d":{"x":[1,"y"]},"s":"q"}'
    rows = spark.createDataFrame([(text,), ('{"b":{"__unchanged__":true}}',), ('{"a":"\\"__unchanged__\\""}',), (None,)], "i string")
    got = rows.select(images.redacted(F.col("i"), ["s"]).alias("r"), images.has_marker(F.col("i")).alias("m")).collect()
    assert got[0].r == text.replace('"q"', "null") and [r.m for r in got] == [False, True, False, False]


def test_divergence_reads_images(spark):
    a = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, None), (3, '{"a":1}')], "event_id long, row_after string")
    b = spark.createDataFrame([(1, '{"b":2,"a":1}'), (2, "{}"), (3, '{"a":2}')], "event_id long, row_after string")
    assert {r.event_id: r.diverges for r in merge.divergence([a, b], ["row_after"]).collect()} == {1: False, 2: False, 3: True}


def test_checksum_is_crc32c():
    assert writers.checksum(b"123456789") == 0xE3069283 and writers.checksum(b"") == 0
