"""Policy files and their defaults."""

from querywarden.sources import policy as P


def test_policy_semantics(spark, tmp_path):
    full = tmp_path / "full.yaml"
    full.write_text("search:\n  enabled: true\n  differential_privacy:\n    decoy_count: 5\n"
                    "    uniqueness_mode: auto-block\n    batch_window: 10.0\n")
    off = tmp_path / "off.yaml"
    off.write_text("search:\n  enabled: false\n")
    empty = tmp_path / "empty.yaml"
    empty.write_text("")
    paths = {"full": str(full), "off": str(off), "empty": str(empty),
             "missing": str(tmp_path / "nope.yaml"), "unset": None}
    rows = {r.policy_id: r for r in P.load_policies(spark, paths).collect()}
    assert (rows["full"].enabled, rows["full"].decoy_count, rows["full"].uniqueness_mode,
            rows["full"].batch_window, rows["full"].dp_enabled) == (True, 5, "auto-block", 10.0, True)
    assert not rows["off"].enabled
    assert not rows["empty"].enabled and not rows["missing"].enabled
    assert rows["unset"].enabled and rows["unset"].decoy_count == 2
    assert rows["unset"].uniqueness_mode == "warn" and rows["unset"].batch_window == 5.0


def test_unknown_policy_is_disabled(spark):
    q = spark.createDataFrame([(1, "reference"), (2, "nope")], "query_id long, policy_id string")
    out = {r.query_id: r.enabled for r in
           P.attach_policy(q, P.policies(spark), n_rows=len(P.POLICY_PROFILES)).collect()}
    assert out == {1: True, 2: False}
