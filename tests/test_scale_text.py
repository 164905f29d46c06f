"""Plans of the text jobs: no step is stated, and so run, more than once."""

from conftest import SF001, one_col
from pyspark.sql import functions as F

from shiftscope import session
from shiftscope.functions import text as T
from shiftscope.operators import extract as X
from shiftscope.operators import pay
from shiftscope.plans.catalog import load_all


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exploded_hours_parse_once(spark):
    # a filter inferred from the generator repeated the whole parse under it
    for name in ("weekday_hours", "working_hours_log"):
        lines = _plan(load_all()[name].build(spark, SF001)).splitlines()
        assert not [x for x in lines if "Filter" in x and "size(" in x], name


def test_benefit_tags_without_lambdas(spark):
    df = spark.createDataFrame([("ДМС, бесплатное питание, скидки",), ("нет",), (None,)], "t string").select(X.benefit_tags(F.col("t")).alias("b"))
    assert [r.b for r in df.collect()] == ["ДМС, питание, бесплатное питание, скидки", None, None]
    assert "lambda" not in _plan(df)


def test_normal_forms_skip_clean_texts(spark):
    odd = ["a  b", " x ", "<b>x</b> y", "a\tb", "n n", "😀 a 😀 b", "<😀>", "<", "plain text", "", None]
    assert one_col(spark, odd, T.clean_text) == ["a b", "x", "x y", "a b", "n n", "a b", "", "<", "plain text", "", ""]
    assert one_col(spark, odd, T.rate_text) == ["a b", "x", "<b>x</b> y", "a b", "n n", "😀 a 😀 b", "<😀>", "<", "plain text", "", ""]
    assert one_col(spark, odd, T.strip_html)[:4] == ["a b", "x", "x  y", "a b"]
    assert "RLIKE" in _plan(spark.createDataFrame([("a",)], "t string").select(T.clean_text(F.col("t"))))


def test_markers_run_behind_their_literals(spark):
    assert X._marker_literals(r"\$\s*/\s*hr") == ["$", "/", "hr"]
    assert X._marker_literals(r"\bсмена\b[^.,;\n\r]{0,12}[–—-]") == ["смена"]
    texts = ["300 в  час", "500 руб. / ч", "часовая ставка", "5 $ / hr", "per-hour", "часы", None]
    assert one_col(spark, texts, X.is_hourly_rate) == [True] * 5 + [False] * 2


def test_spans_scan_once(spark):
    df = spark.createDataFrame([("с 9:00 до 21:00, \u0001смена\u0002 8 часов",), ("",)], "t string").select(
        X._match_spans(F.col("t"), X.HOURS_RE).alias("s"))
    (first,), second = df.collect()[0].s, df.collect()[1].s
    assert (first.m, first.s, first.ctx, second) == ("8 часов", 25, "с 9:00 до 21:00, \u0001смена\u0002 8 часов", [])
    assert _plan(df).count("regexp_extract_all") == 0


def test_legacy_row_states_each_step_once(spark):
    rec = spark.createDataFrame([("1", None, "e", "p", 100.0, 200.0, "RUB", "per_month", None, "2/2, 5/2", "2/2", None, None, ["a"], None, "u", None)],
                                "external_id string, title string, employer_name string, published string, salary_from double, salary_to double,"
                                " salary_currency string, salary_period string, shift_length_hours double, schedule_hint string, shift_pattern string,"
                                " experience string, employment_type string, benefits array<string>, duties_raw string, url_detail string, region string")
    out = pay.legacy_row(rec)
    plan = _plan(out)
    assert plan.count("keys: [5/2,2/2") < 12                 # the schedule tables were stated over and over
    row = out.first()
    assert (row.hourly_method, row.shift_hours, row.schedule) == ("derived:salary_based", 12.0, "2/2, 5/2")


def test_benefit_lines_in_one_pass(spark):
    values = ["x\r- ФОРМА -\r\n\n• обеды\t", "сменн\nграфик", "Сменный график", "прое\u1c83т проез\u1c81", " -•\t", "", None, "пита" * 20_000]
    want = [["ФОРМА", "обеды"], [], ["Сменный график"], ["прое\u1c83т проез\u1c81"], [], [], [], []]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", X.benefit_lines(F.col("t")).alias("lines"))
    assert [r.lines for r in df.orderBy("i").collect()] == want
    plan = _plan(df)
    assert "split(" not in plan and "filter(" not in plan


def test_a_limit_of_the_submitter_stays(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    session.compile_wide_rows(spark)
    assert spark.conf.get(key) == "8000"
    spark.conf.set(key, "9000")
    session.compile_wide_rows(spark)
    assert spark.conf.get(key) == "9000"
    spark.conf.unset(key)
