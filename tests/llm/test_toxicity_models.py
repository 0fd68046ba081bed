"""The models as tables against the one in memory."""

import math
import random

import pytest

from marketshape.llm.toxicity import KneserNey, log_ratios, of_weight


def test_log_ratios_use_every_trigram(spark):
    g = random.Random(5)
    rows = {f"{a} {b} {c}": g.choice([(0.0, 0.0), (0.0, 0.004), (0.0, 3.0), (1.0, 0.0), (2.0, 0.5)]) for a, b, c in ((g.choice("abcd"), g.choice("abcd"), g.choice("abcdefgh")) for _ in range(120))}
    follow: dict = {}
    for k in rows:
        _, b, w = k.split(" ")
        follow.setdefault(w, set()).add(b)
    sizes = {w: len(x) for w, x in follow.items()}
    m = KneserNey({"harmful": {k: h for k, (h, _) in rows.items() if h}, "ordinary": {k: o for k, (_, o) in rows.items() if o}}, follow=(sizes, sum(sizes.values()), len(sizes)))
    got = {r["gram"]: r["x"] for r in log_ratios(spark.createDataFrame([(k, *v) for k, v in rows.items()], "gram string, h double, o double")).collect()}
    assert got == pytest.approx({k: math.log(m.p("harmful", *k.split(" ")) / m.p("ordinary", *k.split(" "))) for k in rows})


def test_learnt_counts_weigh_the_same_on_ten_times_the_input(spark):
    rows = [("a b c", 40.0, 0.1), ("b c d", 160.0, 0.0)]
    got = [{r["gram"]: (r["h"], r["o"]) for r in of_weight(spark.createDataFrame([(k, h * n, o) for k, h, o in rows], "gram string, h double, o double"), "h", 100).collect()} for n in (1, 10)]
    assert got[0] == got[1] == {"a b c": (20.0, 0.1), "b c d": (80.0, 0.0)}
    few = of_weight(spark.createDataFrame([("a b c", 4.0, 0.0)], "gram string, h double, o double"), "h", 100)
    assert few.first()["h"] == 4.0
