"""Rules for annotations: each error by itself, nulls everywhere, the image only with vision."""

from gridloom.operators import rules

SCHEMA = "sample string, kind string, id string, status string, score double, confidence double, cites array<string>, reason string"
DEFINITIONS = [("concepts", "c1", ["ndvi"], "optical"), ("concepts", "c2", ["soil"], "soil"), ("rules", "r1", ["ndvi"], None)]


def errors(spark, rows, vision=False):
    d = spark.createDataFrame(DEFINITIONS, "kind string, id string, channels array<string>, family string")
    return {tuple(r) for r in rules.annotation_errors(spark.createDataFrame(rows, SCHEMA), d, ["ndvi", "rain"], vision).collect()}


def full(sample, **changes):
    """A flawless sample, with some records changed."""
    base = {
        "c1": ("concepts", "estimated", 0.5, 1.0, ["channels.ndvi", "dates"], "seen"),
        "c2": ("concepts", "unknown", None, None, [], "no data"),
        "r1": ("rules", "estimated", 0.0, 0.2, ["channels.rain"], "rule"),
    }
    return [(sample, (k := changes.get(i, v))[0], i, *k[1:]) for i, v in base.items() if changes.get(i, v) is not None]


def test_flawless(spark):
    assert errors(spark, full("a") + full("b", r1=("rules", "not_observable", None, None, ["dates"], "x"))) == set()


def test_each_rule(spark):
    e = lambda **c: {(i, x) for _, i, x in errors(spark, full("a", **c))}
    assert e(c1=None) == {(None, "missing ids")}
    assert e(c1=("concepts", None, None, None, [], "x")) == {("c1", "invalid status")}
    assert e(c1=("concepts", "estimated", 1.5, None, ["channels.ndvi"], "x")) == {("c1", "invalid score")}
    assert e(c2=("concepts", "unknown", 0.0, None, [], "x")) == {("c2", "unknown is not a negative")}
    assert e(c2=("concepts", "estimated", 0.1, 0.1, ["channels.ndvi"], "x")) == {("c2", "unsupported citation"), ("c2", "no sensor evidence")}
    assert e(c1=("concepts", "estimated", 0.1, 0.1, ["dates"], "x")) == {("c1", "no sensor evidence")}
    assert e(r1=("rules", "estimated", 0.1, 0.1, ["dates"], "x")) == set()  # a rule may rest on dates
    assert e(r1=("rules", "estimated", 0.1, 0.1, None, None)) == {("r1", "unsupported citation"), ("r1", "estimate without evidence"), ("r1", "no reason")}
    assert errors(spark, full("a") + full("a")[:1]) == {("a", "c1", "repeated id")}
    assert errors(spark, [*full("a"), ("a", "rules", "c1", "unknown", None, None, [], "x")]) == {("a", "c1", "unknown id")}
    assert (None, None, "missing ids") in errors(spark, [(None,) * 8])


def test_images_need_vision(spark):
    seen = full("a", c1=("concepts", "estimated", 0.1, 0.1, ["image"], "x"), r1=("rules", "estimated", 0.1, 0.1, ["image"], "x"), c2=("concepts", "estimated", 0.1, 0.1, ["image", "channels.soil"], "x"))
    assert errors(spark, seen, vision=True) == {("a", "c2", "unsupported citation")}
    assert {i for _, i, _ in errors(spark, seen)} == {"c1", "c2", "r1"}
