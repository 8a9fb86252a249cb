"""Scores recomputed from published attributions, and the edge cases."""

import pytest

from blamesplit.functions.local import local_table
from blamesplit.operators import scoring
from blamesplit.plans import reports

# Published values of one scenario (culprit agg_transactions) and the mass they should give.
OPS = [
    "agg_transactions", "clean_customers", "encode_features", "filter_active", "join_features",
    "load_customers", "load_transactions",
]
PUBLISHED = {
    "shapley": ([-0.0996, 0, 0, 0, 0, -0.0201, 0.0048], 0.83),
    "shapley_mc": ([-0.1048, 0, 0, 0, 0, -0.0197, 0.0096], 0.84),
    "loo": ([-0.1147, 0, 0, 0, 0, -0.0259, 0.0090], 0.82),
    "stagewise_a": ([-0.1147, 0, 0, 0, 0, -0.0556, 0.0554], 0.67),
    "stagewise_b": ([-0.1147, 0, 0, 0, 0, 0.0405, -0.0407], 0.74),
    "drift": ([-0.9256, -0.0167, -0.3531, -0.4740, -0.4638, -0.0167, -0.0200], 0.41),
}


@pytest.fixture(scope="module")
def attribution(spark):
    rows = [
        ("s", m, op, float(x)) for m, (phis, _) in PUBLISHED.items() for op, x in zip(OPS, phis)
    ]
    rows += [("flat", "shapley", op, 0.0) for op in OPS]
    return local_table(spark, "scenario string, method string, op string, phi double", rows)


def test_published_scores(spark, attribution):
    culprits = local_table(spark, "scenario string, op string", [("s", "agg_transactions"), ("flat", "join_features")])
    found = {(r.scenario, r.method): r for r in scoring.scores(attribution, culprits).collect()}
    for method, (_, mass) in PUBLISHED.items():
        row = found["s", method]
        assert (row.p_at_1, row.mrr) == (1.0, 1.0)
        assert round(row.mass, 2) == mass
    flat = found["flat", "shapley"]
    assert (flat.p_at_1, flat.mrr, flat.mass) == (0.0, 0.2, 0.0)


def test_ties_rank_by_name(attribution):
    ranked = scoring.blame_ranking(attribution).where("scenario = 'flat'").orderBy("rank").collect()
    assert [r.op for r in ranked] == sorted(OPS)


def test_no_culprit_scores_zero(spark, attribution):
    nobody = local_table(spark, "scenario string, op string", [("s", "someone_else")])
    row = scoring.scores(attribution, nobody).where("method = 'loo'").collect()[0]
    assert (row.p_at_1, row.mrr, row.mass) == (0.0, 0.0, 0.0)


# Published ladder rows above the measurable limit: ratio and p@1 per method.
LADDER = [
    (0.6737732992479717, 0, 1, 1, 1, 0), (0.4, 1, 1, 1, 1, 0), (0.05, 0, 1, 1, 1, 0),
    (0.2, 1, 1, 1, 1, 0), (0.13, 0, 1, 1, 0, 0), (2.5, 1, 1, 1, 1, 1), (1.5, 1, 1, 1, 1, 1),
]


def ladder_rows(spark):
    rows = [
        ("f", str(i), r, True, *map(float, p), 0.0, 0.1 * i) for i, (r, *p) in enumerate(LADDER)
    ]
    rows.append(("f", "tiny", 0.01, False, *[0.0] * 5, 0.0, 0.1))
    scores = ", ".join(f"{m}_p_at_1 double" for m in reports.METHODS)
    return local_table(
        spark,
        f"fault_type string, severity string, ratio double, measurable boolean, {scores}, "
        "anchored_eff_gap double, loo_eff_gap double",
        rows,
    )


def test_ratio_bins(spark):
    found = {r.ratio_bin: r for r in reports.ratio_bins(ladder_rows(spark), reports.RATIO_BINS).collect()}
    assert {k: r.n for k, r in found.items()} == {
        "r < 0.25": 3, "0.25 - 0.5": 1, "0.5 - 1": 1, "1 - 2": 1, "r > 2": 1, "OVERALL": 7,
    }
    assert found["r < 0.25"].shapley == pytest.approx(1 / 3)
    assert found["OVERALL"].anchored == 1.0
    coarse = {r.ratio_bin: r.n for r in reports.ratio_bins(ladder_rows(spark), reports.COARSE_BINS).collect()}
    assert coarse["r < 0.5"] == 4
    assert [r.severity for r in reports.excluded(ladder_rows(spark)).collect()] == ["tiny"]


def test_method_agreement(spark):
    row = reports.method_agreement(ladder_rows(spark)).collect()[0]
    assert (row.agree, row.live) == (7, 7)
    assert row.loo_gap_max == pytest.approx(0.6)


def test_case_validity(spark):
    rows = [("x", -0.05, -0.04), ("x", -0.05, 0.001), ("x", 0.01, -0.04), ("x", -0.002, -0.002)]
    df = local_table(spark, "fault_type string, delta double, fault_alone double", rows)
    found = [r.reason for r in reports.case_validity(df).collect()]
    assert found == ["valid", "fault does no harm", "no net degradation", "valid"]


def test_gate_summary_scores_every_group(spark):
    incidents = [
        reports.Incident("a", culprits=("a",), group="harmful"),
        reports.Incident("a+b", culprits=("a", "b"), group="harmful"),
        reports.Incident("c", culprits=("c",), group="benign"),
        reports.Incident("d", culprits=("d",), group="benign"),
    ]
    blame = {
        "a": {"a": -0.3, "c": -0.1, "d": 0.0}, "a+b": {"a": -0.1, "b": -0.1, "d": -0.2},
        "c": {"c": -0.01, "d": -0.03}, "d": {"a": 0.0, "c": 0.0, "d": 0.0},
    }
    rows = [(s, "loo", op, phi) for s, phis in blame.items() for op, phi in phis.items()]
    table = local_table(spark, "scenario string, method string, op string, phi double", rows)
    found = {r.grp: tuple(r)[2:] for r in reports.gate_summary(reports.Study(spark, None, incidents), table).collect()}
    assert found == {
        "harmful": pytest.approx((2, 0.5, 0.75, 0.625)),
        "compound": pytest.approx((1, 0.0, 0.5, 0.5)),
        "benign": pytest.approx((2, 0.0, (0.5 + 1 / 3) / 2, 0.125)),
    }
