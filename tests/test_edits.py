"""Trees of codes and narrowing rules on hand-made rows."""

from quipu.operators import rules, tree


def test_code_tree_prefers_the_longest_prefix_and_reports_indentation(spark):
    nodes = [(1, "0101000000", 1), (2, "0101200000", 2), (3, "0101210000", 3), (4, "0101300000", 3), (5, "0102900000", 2), (6, None, 1)]
    got = {r.seq: r for r in tree.code_tree(spark.createDataFrame(nodes, "seq long, code string, level int"), stem=4, levels=3).collect()}
    assert [got[i].parent for i in range(1, 7)] == [None, "0101000000", "0101200000", "0101000000", None, None]
    assert got[4].by_indent == "0101200000" and not got[4].agrees and got[3].agrees
    assert [got[i].terminal for i in range(1, 6)] == [False, False, True, True, True]
    assert len(got) == 6


def test_narrowing_rule_evaluates_first_then_weighs(spark):
    rows = [
        ("a", "r1", 1, 0.95, False, ["x", "y"]), ("a", "r2", 2, 0.75, False, ["x"]), ("a", "r3", 3, 0.70, True, ["x"]),
        ("b", "r1", 1, 0.95, False, ["x"]), ("b", "r2", 2, 0.75, False, ["y"]),
        ("c", "r1", 1, 0.95, False, ["x"]),
        ("d", "r1", 1, 0.95, False, ["x", "y"]), ("d", "r2", 2, 0.75, True, ["x", "z"]),
        ("e", "r1", 1, 0.75, False, ["x"]), ("e", "r2", 2, 0.75, False, ["x"]),
    ]
    df = spark.createDataFrame(rows, "item string, rule string, place int, weight double, evaluates boolean, categories array<string>")
    got = {r.item: (r.n, r.common, r.leader) for r in rules.narrowing_rule(df).collect()}
    assert got == {"a": (3, ["x"], "r3"), "b": (2, [], None), "c": (1, ["x"], None), "d": (2, ["x"], None), "e": (2, ["x"], "r1")}
