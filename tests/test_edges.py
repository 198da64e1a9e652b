
from decimal import Decimal

from pyspark.sql import functions as F

from cadence.functions import text as X
from cadence.functions.expr import has_ac
from cadence.operators import metrics, silver
from tests import brute
from tests.seed import ISSUES, SPRINTS, issue_rows, make_tables, project_rows, sprint_rows


def test_sprint_without_issues_and_empty_project(spark):
    projects = project_rows([(1, "TEAM", "Team Project"), (2, "EMPTY", "Empty")])
    sprints = sprint_rows(SPRINTS + [(5, "Sprint 5", "closed", 3, 1, 0)])
    t = make_tables(spark, projects=projects, sprints=sprints)
    tr = {r.sprint_id: r for r in metrics.velocity_trend(t, None, 3).collect()}
    assert (tr[5].completed_points, tr[5].committed_points, tr[5].total_issues) == (0.0, 0.0, 0)
    sc = {r.sprint_id: r for r in metrics.scope_creep(t, 1, 5).collect()}
    assert sc[5].scope_creep_pct == 0.0 and sc[5].total_points == 0.0
    comp = {r.sprint_id: r for r in metrics.sprint_completion(t, 1, 5).collect()}
    assert comp[5].completion_pct_points == 0.0 and comp[5].completion_pct_issues == 0.0
    assert 5 not in {r.sprint_id for r in metrics.time_tracking(t, 1, 5).collect()}
    v = {r.project_id: r for r in metrics.velocity(t).collect()}
    assert v[2].sprints_analysed == 0 and v[2].average_completed_points is None and v[2].predictability_pct is None
    b = {r.project_id: r for r in metrics.backlog_readiness(t).collect()}
    assert b[2].total_backlog == 0 and b[2].ac_readiness_pct is None
    h = {r.project_id: r for r in metrics.delivery_health(t).collect()}
    assert h[2].current_sprint_name is None and h[2].cycle_sample_size == 0


def test_null_dates_follow_postgres_order(spark):
    sprints = sprint_rows(SPRINTS + [(6, "Open closed", "closed", 80, 70, None), (7, "No start", "active", None, None, None)])
    issues = issue_rows(ISSUES + [("TEAM-98", 7, "Story", "Done", 1, False, None, None, None)])
    t = make_tables(spark, sprints=sprints, issues=issues)
    first_closed = [r for r in metrics.velocity_trend(t, 1, 1).collect()]
    assert [r.sprint_id for r in first_closed] == [6]
    first_started = metrics.scope_creep(t, 1, 1).collect()
    assert [r.sprint_id for r in first_started] == [7]
    tt = sorted(metrics.time_tracking(t, 1, 10).collect(), key=lambda r: r.recency_rank)
    assert tt[-1].sprint_id == 7


def test_single_observation_and_bad_intervals(spark):
    issues = issue_rows([
        ("A-1", 1, "Story", "Done", 1, False, 10, 7, None),
        ("A-2", 1, "Story", "Done", 1, False, 10, 10, None),  # done == in progress: excluded
        ("A-3", 1, "Story", "Done", 1, False, 5, 9, None),  # done before start: excluded
    ])
    t = make_tables(spark, issues=issues)
    r = metrics.cycle_time(t, 1).collect()[0]
    assert r.sample_size == 1 and r.stddev_days is None
    assert r.p50_days == r.p95_days == r.mean_days == 3.0


def test_null_status_category_dropped_from_by_status(spark):
    issues = issue_rows(ISSUES + [("TEAM-99", None, "Story", None, 7, False, None, None, "x")])
    rows = make_tables(spark, issues=issues)
    s = {r.status_category: r.pct_of_total for r in metrics.distribution_by_status(rows, 1).collect()}
    assert None not in s and s["Done"] == brute.by_status()["Done"][2]
    t = metrics.distribution_by_type(rows, 1).filter(F.col("status_category").isNull()).collect()
    assert [(r.issue_type, r.total_points) for r in t] == [("Story", 7.0)]
    b = metrics.backlog_readiness(rows, 1).collect()[0]
    assert b.total_backlog == brute.backlog()[0]  # NULL category is not "!= 'Done'"


def test_committed_zero_gives_null_predictability(spark):
    issues = issue_rows([("B-1", 1, "Story", "Done", 3, True, None, None, None)])
    sprints = sprint_rows([SPRINTS[0]])
    t = make_tables(spark, sprints=sprints, issues=issues)
    r = metrics.velocity(t, 1).collect()[0]
    assert r.average_committed_points == 0.0 and r.predictability_pct is None


def test_imputation_decimal_ties(spark):
    secs = [0, 480, 9600, 10080, 13920, 14880]
    df = spark.createDataFrame([(s, None, None) for s in secs], "t long, est long, sp decimal(6,1)")
    got = [r.v for r in df.select(X.impute_points(F.col("sp"), F.col("t"), F.col("est")).alias("v")).collect()]
    assert got == [Decimal(x) for x in ("1.0", "1.0", "1.0", "1.1", "1.4", "1.6")]
    manual = spark.createDataFrame([(Decimal("8.0"), 14400, None), (Decimal("8.0"), 0, 4800)], "sp decimal(6,1), t long, est long")
    got = [r.v for r in manual.select(X.impute_points("sp", "t", "est").alias("v")).collect()]
    assert got == [Decimal("1.5"), Decimal("8.0")]


def test_parse_ts_shapes(spark):
    vals = ["2024-01-02T03:04:05.123+0000", "2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05+0000",
            "2024-01-02", "2024-01", "2024-01-02T03:04:05", "02/01/2024 03:04", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.t for r in df.select(F.date_format(X.parse_ts("s"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).collect()]
    assert got == ["2024-01-02 03:04:05.123000", "2024-01-02 03:04:05.123456", "2024-01-02 03:04:05.000000",
                   "2024-01-02 00:00:00.000000", None, None, None, None]


def test_story_points_falsy_fallback(spark):
    rows = [("5", "3"), ("", "3"), ("0", "3"), (None, "2.5"), ("abc", "3"), (None, None), ("0", "0")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.v for r in df.select(X.story_points("a", "b").alias("v")).collect()]
    assert got == [5.0, 3.0, 3.0, 2.5, None, None, 0.0]


def test_acceptance_criteria_rules(spark):
    rows = [
        ("  ", "AC: something"),          # dedicated field truthy even if blank
        (None, "Intro. Given x, AC: then y  "),  # list order: 'ac:' before 'given '
        (None, "Scenario: login"),
        (None, "no markers here"),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "ded string, d string")
    out = df.select(X.acceptance_criteria("ded", "d").alias("ac"))
    got = [r.ac for r in out.collect()]
    assert got == ["  ", "AC: then y", "Scenario: login", None, None]
    flags = [r.f for r in out.select(has_ac("ac").alias("f")).collect()]
    assert flags == [False, True, True, False, False]


def test_extract_text_nested_json(spark):
    doc = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"Hello \\"you\\""},' \
          '{"type":"text","text":"  world"}]},{"type":"bulletList","content":[{"type":"listItem","content":' \
          '[{"type":"paragraph","content":[{"type":"text","text":"deep\\nline"}]}]}]}]}'
    df = spark.createDataFrame([(doc,), ("plain text",), (None,)], "d string")
    got = [r.t for r in df.select(X.extract_text("d").alias("t")).collect()]
    assert got == ['Hello "you" world deep line', "plain text", ""]


def test_extract_text_exact_keeps_reference_spacing(spark):
    import json

    docs = [
        {"type": "doc", "content": [
            {"type": "paragraph", "content": [{"type": "text", "text": "  Hello "}, {"type": "text", "text": "world"}]},
            {"type": "paragraph", "content": []},
            {"type": "paragraph", "content": [{"type": "text", "text": "end"}]}]},
        [{"text": "a"}, {"text": ""}, {"text": "b"}],
        {"type": "doc", "content": [{"content": [{"content": [{"content": [{"text": "deep"}]}]}]}]},
        {},
    ]
    rows = [(json.dumps(d),) for d in docs] + [("plain  text",), (None,), ("{bad json",)]
    df = spark.createDataFrame(rows, "d string")
    got = [r.t for r in df.select(X.extract_text_exact("d").alias("t")).collect()]
    assert got == ["Hello world  end", "a  b", "deep", "", "plain  text", "", "{bad json"]


def test_quality_audits(spark):
    from cadence.operators import quality

    child = spark.createDataFrame(
        [(1, "a", 10), (2, None, 10), (2, "zz", 11), (3, "b", None), (4, "a", 99), (5, "a", 99)],
        "k long, s string, fk long")
    parent = spark.createDataFrame([(10,), (11,)], "id long")
    rep = quality.report([
        quality.unique(child, ["k"], "c"),
        quality.row_checks(child, "c", not_null=["s"], domains={"s": ["a", "b"]}),
        quality.foreign_key(child, ["fk"], parent, ["id"], "c"),
    ])
    got = {(r.check_name, r.table_name): r.bad_rows for r in rep.collect()}
    # NULL passes a CHECK domain (as in SQL); NULL foreign keys are not violations.
    assert got == {("unique(k)", "c"): 1, ("not_null(s)", "c"): 1, ("domain(s)", "c"): 1,
                   ("foreign_key(fk)", "c"): 2}


def _changelog(spark, histories):
    from cadence.sources.schemas import CHANGELOG

    return spark.createDataFrame([(1, 0, (0, histories))], f"issue_id long, page long, changelog {CHANGELOG.simpleString()}")


def test_transition_dates_encounter_vs_time(spark):
    item = lambda to: [("status", None, to)]
    hist = [
        ("2024-01-05T00:00:00+0000", None, item("Done")),
        ("garbage", None, item("In Progress")),
        ("2024-01-03T00:00:00+0000", None, item("In Progress")),
        ("2024-01-01T00:00:00+0000", None, item("Closed")),
    ]
    df = _changelog(spark, hist)
    enc = silver.transition_dates_by_issue(df).collect()[0]
    tim = silver.transition_dates_by_issue(df, order="time").collect()[0]
    assert str(enc.in_progress_at)[:10] == "2024-01-03" and str(enc.done_at)[:10] == "2024-01-05"
    assert str(tim.done_at)[:10] == "2024-01-01"


def test_history_dedupe_and_append(spark):
    hist = [("2024-01-01T00:00:00+0000", ("a@x",), [("status", "To Do", "In Progress"), ("labels", None, "x")])] * 2
    df = _changelog(spark, hist)
    h = silver.status_history(df)
    assert h.count() == 1
    assert silver.append_history(h, h).count() == 0


def test_rich_text_of_any_depth_without_attrs(spark):
    import json

    deep = {"type": "text", "text": "bottom"}
    for _ in range(200):
        deep = {"type": "listItem", "content": [deep]}
    fourteen = {"content": [{"text": "a"}, {"text": ""}, {"text": "b"}]}
    for _ in range(14):
        fourteen = {"content": [fourteen]}
    mention = {"type": "paragraph", "content": [{"type": "text", "text": "ping "}, {"type": "mention", "attrs": {"text": "@Bob DONE"}}]}
    rows = [(json.dumps(deep),), (json.dumps(fourteen),), (json.dumps(mention),), ("[UI] Login fails. Given a user",), ("{code}x{code} AC: y",), ("[1, 0, true]",), ("7",)]
    df = spark.createDataFrame(rows, "d string")
    got = [r.t for r in df.select(X.extract_text_exact("d").alias("t")).collect()]
    assert got == ["bottom", "a  b", "ping", "[UI] Login fails. Given a user", "{code}x{code} AC: y", "1  True", "7"]
    assert [r.t for r in df.select(X.extract_text("d").alias("t")).collect()][:5] == ["bottom", "a b", *got[2:5]]
    ac = df.select(X.acceptance_criteria(F.lit(None).cast("string"), X.extract_text_exact("d")).alias("ac")).collect()
    assert [r.ac for r in ac][3:5] == ["Given a user", "AC: y"]


def test_row_number_by_group_equals_a_window(spark):
    from pyspark.sql import Window

    from cadence.functions.ranking import row_number_by_group

    # Group 0 holds most rows, some groups are NULL, and a payload rides along.
    df = spark.range(0, 200_000).select(
        F.when(F.col("id") % 10 < 8, F.lit(0)).when(F.col("id") % 10 == 8, F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(F.col("id") * 7919 % 900_000)).alias("v"),
        F.col("id"),
        F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("payload"),
    ).repartition(7)
    order = [F.col("v").desc_nulls_first(), F.col("id").asc()]
    levels = [[(F.to_date("v"), False)], [(F.date_trunc("MINUTE", "v"), False)], [(F.col("v"), False), (F.floor(F.col("id") / 1000), True)]]
    got = row_number_by_group(df, "g", order, levels)
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("want"))
    both = got.join(want, "id")
    assert both.count() == 200_000 and both.where("idx <> want or payload is null").count() == 0


def test_audit_reads_each_table_once(spark, tmp_path):
    from cadence.operators import quality

    rows = [(1, "a", 10, "x"), (2, None, 10, "x"), (2, "zz", 11, None), (None, "b", None, "x"), (None, "a", 99, "x"), (5, "a", 99, "x")]
    spark.createDataFrame(rows, "k long, s string, fk long, payload string").write.parquet(str(tmp_path / "c"))
    tables = {"c": spark.read.parquet(str(tmp_path / "c")), "p": spark.createDataFrame([(10,), (11,), (11,)], "id long")}
    rules = {"c": quality.Rules(not_null=("s", "payload"), domains={"s": ("a", "b")}, unique=(("k",), ("k", "s")), foreign={"fk": ("p", "id")})}
    found = quality.audit(tables, rules)
    got = {r.check_name: r.bad_rows for r in found.collect()}
    # NULL keys never clash, NULL passes a domain, a NULL foreign key points nowhere.
    assert got == {"not_null(s)": 1, "not_null(payload)": 1, "domain(s)": 1, "unique(k)": 1, "unique(k,s)": 0, "foreign_key(fk)": 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "payload" in line for line in plan.split("\n")) == 1
