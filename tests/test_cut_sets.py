"""Cut sets over gates whose ids are numbers, and sets that several ways lead to."""

from riskweave.plans import quantify


def test_ids_may_be_numbers_and_sets_found_twice_are_one(spark):
    # 1 = 10 and 20; 10 = a or b, 20 = a or b: {a, b} is found in two ways; repeated arguments and tops change nothing
    rows = [(1, "and", 10, True), (1, "and", 20, True), (1, "and", 20, True)] + [(g, "or", e, False) for g in (10, 20) for e in (100, 101)]
    args = spark.createDataFrame(rows, "gate long, connective string, arg long, is_gate boolean")
    tops = spark.createDataFrame([(1,), (1,)], "gate long")
    cuts = lambda **how: sorted(tuple(r.cut) for r in quantify.cut_sets(tops, args, **how).collect())
    assert cuts(absorb=False) == [(100,), (100, 101), (101,)]
    assert cuts() == [(100,), (101,)]
