"""Hand-worked values of single operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from perfsieve.functions import backfill, numeric, text
from perfsieve.operators import enrich, evaluate, serialize, splits
from perfsieve.session import materialize


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_platforms(spark):
    names = ["linux1804-64-shippable-qr", "android-hw-a51-11-0-aarch64-shippable", "fenix-armv7", "windows10-32",
             "macosx1015-64", "osx-10-10", "Darwin-x86_64", "solaris-x86", "linux-armhf 64", "freebsd", None]
    assert column(spark, names, numeric.platform_os) == [
        "linux", "android", "android", "windows", "mac", "mac", "windows", "solaris", "linux", "freebsd", "unknown"]
    assert column(spark, names, numeric.platform_arch) == [
        "x64", "aarch64", "arm", "x86", "x64", "unknown", "x64", "x86", "arm", "unknown", "unknown"]


def test_related_ids(spark):
    texts = ["|123|456|", "123", " |5| ", "||", "12|ab|7", "12| 13", "1||2", "", "  ", None, "123.0"]
    assert column(spark, texts, numeric.related_count) == [2, 1, 1, 0, 2, 1, 2, 0, 0, 0, 0]


def test_clean_number(spark):
    assert column(spark, ["(1,", "1,234)", "n/a", None, ""], numeric.clean_number) == [1.0, 1234.0, 0.0, 0.0, 0.0]


BACKFILLS = [
    ('{"x": [{"value":1,"push_timestamp":"01"},{"value":3,"push_timestamp":"02"},{"value":2,"push_timestamp":"03"},'
     '{"value":6,"push_timestamp":"04"}]}', (3.0, 1.8708286933869707, 1.4, 4)),
    ('[{"value":2,"push_timestamp":"03"},{"value":1,"push_timestamp":"01"},{"value":6,"push_timestamp":"04"},'
     '{"value":3,"push_timestamp":"02"}]', (3.0, 1.8708286933869707, 1.4, 4)),
    ('[{"value":5,"push_timestamp":"a"},{"value":5,"push_timestamp":"b"}]', (5.0, 0.0, 0.0, 2)),
    ("[{'value':1,'push_timestamp':'a'},{'value':2,'push_timestamp':'b'}]", (1.5, 0.5, 1.0, 2)),
    ('"[{\\"value\\":1,\\"push_timestamp\\":\\"a\\"},{\\"value\\":2,\\"push_timestamp\\":\\"b\\"}]"', (1.5, 0.5, 1.0, 2)),
    ('[{""value"":1,""push_timestamp"":""a""},{""value"":2,""push_timestamp"":""b""}]', (1.5, 0.5, 1.0, 2)),
    ('[{"value":1,"push_timestamp":null},{"value":"2","push_timestamp":"A"}]', (1.5, 0.5, -1.0, 2)),
    ('[{"value":1,"push_timestamp":"a"},3,{"value":null,"push_timestamp":"b"},{"value":9},{"value":2,"push_timestamp":"c"}]',
     (1.5, 0.5, 1.0, 2)),
    ('[{"value":1,"push_timestamp":"a"}]', (-1.0, -1.0, 0.0, 0)),
    ('[{"value":1,"push_timestamp":"a"},{"value":2', (-1.0, -1.0, 0.0, 0)),
    ("no list", (-1.0, -1.0, 0.0, 0)),
    ("] before [", (-1.0, -1.0, 0.0, 0)),
    (None, (-1.0, -1.0, 0.0, 0)),
]


@pytest.mark.parametrize("given,expected", BACKFILLS)
def test_backfill(spark, given, expected):
    row = backfill.add_backfill_stats(spark.createDataFrame([(given,)], "t string"), "t").first()
    assert tuple(row)[1:] == pytest.approx(expected)


def test_signed_log_z(spark):
    rows = spark.createDataFrame(
        [(7.0, 3.0, 1.8708286933869707, 4), (7.0, 5.0, 0.0, 2), (7.0, -1.0, -1.0, 0), (None, 1.0, 1.0, 3)],
        "v double, m double, s double, n int",
    )
    z = numeric.signed_log_z(F.col("v"), F.col("m"), F.col("s"), F.col("n"))
    assert [r[0] for r in rows.select(z).collect()] == pytest.approx([1.1435778963755892, 9.90353755128617, 0.0, 0.0])


def test_calendar_and_clock(spark):
    rows = spark.createDataFrame([("2024-01-06 06:00:00",), ("2024-01-08 00:00:00",), (None,)], "t string")
    t = F.col("t").try_cast("timestamp")
    out = rows.select(numeric.day_of_week(t), numeric.is_weekend(t), numeric.hour_sin(t), numeric.hour_cos(t)).collect()
    assert tuple(out[0])[:2] == (5, 1) and tuple(out[0])[2:] == pytest.approx((1.0, 0.0), abs=1e-12)
    assert tuple(out[1]) == (0, 0, 0.0, 1.0)
    assert tuple(out[2]) == (None, 0, None, None)


def test_weights(spark):
    rows = spark.createDataFrame(
        [(True, "p1 "), (True, "Critical"), (True, "P2"), (True, "P4"), (False, "P1"), (True, None), (None, "P1")],
        "b boolean, p string",
    )
    weights = [r[0] for r in rows.select(numeric.severity_weight(F.col("b"), F.col("p"))).collect()]
    assert weights == [10.0, 10.0, 5.0, 1.0, 1.0, 1.0, 1.0]


def test_duplicate_bugs_keep_the_heaviest(spark):
    summary = spark.createDataFrame([(1, True, 7), (2, False, None), (3, True, 8)], "alert_summary_id long, bug_created boolean, bug_id long")
    bugs = spark.createDataFrame([(7, "P3"), (7, "P1"), (7, None), (9, "P2")], "id long, priority string")
    out = {r["alert_summary_id"]: r["sample_weight"] for r in enrich.add_sample_weight(summary, bugs).collect()}
    assert out == {1: 10.0, 2: 1.0, 3: 1.0}
    assert {r["sample_weight"] for r in enrich.add_sample_weight(summary, None).collect()} == {1.0}


def test_gap(spark):
    rows = spark.createDataFrame(
        [(3, "2024-01-01 00:10:00.5"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00.5"), (4, None)], "alert_summary_id long, t string"
    ).withColumn("push_timestamp", F.col("t").try_cast("timestamp"))
    gaps = {r["alert_summary_id"]: r for r in enrich.add_push_gap(rows).collect()}
    assert {k: r["seconds_since_last_push"] for k, r in gaps.items()} == {1: 3600.0, 2: 600.5, 3: 0.0, 4: 3600.0}
    assert gaps[2]["log_time_since_last_push"] == pytest.approx(math.log1p(600.5))


def test_text_lengths(spark):
    assert column(spark, [None, "a  b ", "é x\n"], text.length_chars) == [0, 5, 4]
    assert column(spark, [None, "a  b ", "é x\n", " "], text.length_words) == [0, 2, 2, 0]


def test_sanitize(spark):
    notes = [
        "See https://bugzilla.example.org/show_bug.cgi?id=1712345 and Bug #1234567, build 20240101 ok 999",
        "bug12",
        "debug 12345",
        "1234 5678",
        "é12345",
        " ",
        None,
    ]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, alert_summary_notes string")
    out = [r["notes_sanitized"] for r in serialize.add_clean_notes(rows).orderBy("i").collect()]
    assert out == [
        "See  BUGZILLA_URL  and  BUG_ID , build  LONG_NUM  ok 999",
        "BUG_ID",
        "debug  LONG_NUM",
        "LONG_NUM   LONG_NUM",
        "é12345",
        "NO_NOTES",
        "NO_NOTES",
    ]
    assert serialize.add_clean_notes(rows.drop("alert_summary_notes")).first()["notes_sanitized"] == "NO_NOTES"


def test_category_tokens(spark):
    values = ["  Foo Bar/Baz ", "***", None, "x" * 60]
    assert column(spark, values, lambda v: text.category_token_v2("c", v)) == ["c=foo_barbaz", "c=empty", "c=missing", "c=" + "x" * 40]
    assert column(spark, values[:3], lambda v: text.category_token_v1("c", v)) == ["c=foo_barbaz", "c=", ""]


def test_label_columns(spark):
    rows = spark.createDataFrame([(1, "Infra, Improvement"), (2, "a,,a"), (3, ""), (4, None)], "i int, tags string")
    out = enrich.add_label_columns(rows, "tags", "tag_").orderBy("i")
    assert out.columns == ["i", "tag_a", "tag_improvement", "tag_infra"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 1, 1), (1, 0, 0), (0, 0, 0), (0, 0, 0)]
    long = enrich.label_rows(rows, "tags", "i").orderBy("i", "label").collect()
    assert [tuple(r) for r in long] == [(1, "improvement"), (1, "infra"), (2, "a")]
    dotted = spark.createDataFrame([("v1.2",), ("v1_2",), ("x;(y)=",)], "tags string")
    flags = enrich.add_label_columns(dotted, "tags", "tag_")
    assert [sum(c) for c in zip(*materialize(flags, "flags").select(*flags.columns).collect())] == [1, 1, 1]
    assert len({enrich.safe_name(n) for n in ("a.b", "a_b", "a\u00b7b", "a\u00b70b", "a..b", "a.\u00b7b", "a\u00b7.b")}) == 7
    options = spark.createDataFrame([("taskcluster-projects/foo/bar,e10s",)], "o string")
    assert enrich.add_label_columns(options, "o", "opt_", options=True).columns == ["opt_e10s", "opt_taskcluster"]


def test_c_formats(spark):
    random.seed(5)
    values = [0.0, -0.0, 1.5, 100.0, 0.5, 12345.678, 123.35, 9999.5, 99995.0, 1e-4, 0.00012345, -3.25, 1e15, 0.99995]
    values += [round(random.uniform(-2000, 2000), random.randint(0, 5)) for _ in range(3000)]
    values += [random.uniform(-1, 1) * 10.0 ** random.randint(-18, 24) for _ in range(3000)]
    assert column(spark, values, text.format_4g, "double") == [f"{v:.4g}" for v in values]
    small = [v for v in values if abs(v) < 1e12]
    assert column(spark, small, text.format_1f, "double") == [f"{v:.1f}" for v in small]


def test_bins(spark):
    train = spark.createDataFrame([(v, 1.0) for v in [1.0, 2.0, 2.0, 2.0, 5.0, 9.0]], "x double, flat double")
    edges = serialize.fit_bin_edges(train, ["x", "flat"])
    tiny = train.select((F.col("x") * 1e-10).alias("x"))
    assert serialize.fit_bin_edges(tiny, ["x"])["x"] == pytest.approx([e * 1e-10 for e in edges["x"]], rel=1e-12)
    assert edges == {"x": [1.0, 1.5, 2.0, 3.5, 5.0, 7.0, 9.0]}
    values = [0.0, 1.0, 1.5, 2.0, 2.5, 3.5, 5.0, 7.0, 9.0, 100.0, None]
    assert column(spark, values, lambda v: numeric.bin_index(v, edges["x"]), "double") == [0, 0, 0, 1, 2, 2, 3, 4, 5, 5, -1]
    signs = column(spark, [3.0, -1.0, 0.0, None], lambda v: numeric.bin_token("f", v, None, 10), "double")
    assert signs == ["f=pos", "f=neg", "f=zero", "f=missing"]


def test_full_text_keeps_empty_tokens(spark):
    rows = spark.createDataFrame([(4.0, 1.0, True, 12.25, "note")], "x double, nobins double, reg boolean, pct double, n string")
    whole = serialize.all_text(["x", "nobins"], {"x": [1.0, 2.0, 5.0]}, F.col("n"), F.col("reg"), F.col("pct"))
    plain = serialize.all_text(["nobins", "x"], {"x": [1.0, 2.0, 5.0]}, F.col("n"))
    assert rows.select(whole, plain).first()[:] == (
        "This is a performance regression. The performance changed significantly by 12.2 percent. | x=q1  | note",
        " |  x=q1 | note",
    )


@pytest.mark.parametrize("n,two,tail,three", [(11, (9, 2), (8, 1), (8, 1, 2)), (3, (3, 0), (2, 1), (1, 1, 1)), (2, (2, 0), (1, 1), (1, 1, 0))])
def test_split_sizes(spark, n, two, tail, three):
    rows = spark.range(n).selectExpr("id AS alert_summary_id", "timestamp_seconds(id * 60) AS push_timestamp")

    def sizes(frame, names):
        counts = {r["split"]: r["count"] for r in frame.groupBy("split").count().collect()}
        assert sum(counts.values()) == n
        return tuple(counts.get(name, 0) for name in names)

    assert sizes(splits.time_split(rows), ["train_val", "test"]) == two
    assert sizes(splits.time_split_with_tail(rows), ["train", "val"]) == tail
    assert sizes(splits.time_split_three(rows), ["train", "val", "test"]) == three


@pytest.mark.parametrize(
    "scores,ap,auc,at",
    [([0.9, 0.8, 0.7, 0.1], 0.8333333, 0.75, {2: (0.5, 0.5), 50: (0.5, 1.0)}), ([0.9, 0.9, 0.5, 0.1], 0.5833333, 0.625, {2: (0.5, 0.5), 50: (0.5, 1.0)})],
)
def test_ranking_metrics(spark, scores, ap, auc, at):
    rows = spark.createDataFrame([(i, label, s) for i, (label, s) in enumerate(zip([1, 0, 1, 0], scores))], "id long, label int, score double")
    assert evaluate.average_precision(rows).first()["average_precision"] == pytest.approx(ap, abs=1e-6)
    assert evaluate.roc_auc(rows).first()["roc_auc"] == pytest.approx(auc)
    got = {r["k"]: (r["precision"], r["recall"]) for r in evaluate.precision_recall_at(rows, [2, 50]).collect()}
    assert got == at


def test_one_class(spark):
    rows = spark.createDataFrame([(1, 1, 0.4), (2, 1, 0.6)], "id long, label int, score double")
    assert evaluate.roc_auc(rows).first()["roc_auc"] is None
    cells = {(r["label"], r["predicted"]): r["share"] for r in evaluate.confusion_shares(rows).collect()}
    assert cells == {(0, 0): 0.0, (0, 1): 0.0, (1, 0): 0.5, (1, 1): 0.5}


def test_confusion_and_class_weights(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    cells = {(r["label"], r["predicted"]): r["share"] for r in evaluate.confusion_shares(rows).collect()}
    assert cells == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.0, (1, 1): 1.0}
    labels = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    weights = {r["label"]: r["weight"] for r in evaluate.class_weights(labels, "label").collect()}
    assert weights == pytest.approx({0: 2 / 3, 1: 2.0})
