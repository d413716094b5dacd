"""The replay grid at any size equals a brute-force count."""
from collections import Counter
from decimal import Decimal

import pytest

from fundflow import config as C
from fundflow.operators import replay as R
from fundflow.plans.catalog import Stages
from paths import SF001
from test_plans import _exchanges


def brute(events, attackers, n):
    """Event by event, then prefix sums, in plain Python."""
    start, end = min(e.ts_ms for e in events), max(e.ts_ms for e in events)
    span = max(end - start, 1)
    frame = lambda t: -(-(t - start) * n // span)
    started, settled, new, eth, laundered = Counter(), Counter(), Counter(), Counter(), Counter()
    first = {a: 0 for a in attackers}
    for e in events:
        k = frame(e.ts_ms)
        started[k] += 1
        settled[frame(e.ts_ms + C.SETTLE_MS)] += 1
        eth[k] += e.amount or Decimal(0)
        laundered[k] += (e.amount or Decimal(0)) if e.label == C.LABEL_EXIT else 0
        for a in (e["from"], e["to"]):
            if a is not None:
                first[a] = min(first.get(a, k), k)
    new.update(first.values())
    out, a, s, w, x, y = [], 0, 0, 0, Decimal(0), Decimal(0)
    for k in range(n + 1):
        a, s, w, x, y = a + started[k], s + settled[k], w + new[k], x + eth[k], y + laundered[k]
        out.append((k, start + k * span / n, a, float(x), float(y), w, a - s))
    return out


@pytest.mark.parametrize("n, block", [(1000, 100), (1000, 1000), (999, 1000), (1, 100_000)])
def test_blocks_equal_brute_force(spark, monkeypatch, n, block):
    p = Stages(spark, SF001)
    events = p.timeline.collect()
    attackers = [r.address for r in R._attackers(p.nodes).collect()]
    monkeypatch.setattr(C, "GRID_BLOCK", block)
    assert sorted(tuple(r) for r in R.frames(p.timeline, p.nodes, n).collect()) == brute(events, attackers, n)


def test_a_million_positions_equal_brute_force(spark):
    p = Stages(spark, SF001)
    n = 1_000_000
    df = R.frames(p.timeline, p.nodes, n)
    got = df.toPandas().sort_values("frame")
    want = brute(p.timeline.collect(), [r.address for r in R._attackers(p.nodes).collect()], n)
    assert len(got) == n + 1
    for i, c in enumerate(["frame", "t_ms", "events", "eth", "laundered", "wallets", "in_flight"]):
        assert got[c].tolist() == [w[i] for w in want], c
    shuffles = _exchanges(df._jdf.queryExecution().executedPlan(), [])
    assert all(rec <= n // C.GRID_BLOCK + 1 for part, rec in shuffles if part.startswith("SinglePartition")), shuffles


def test_no_steps():
    with pytest.raises(ValueError):
        R.frames(None, None, 0)
