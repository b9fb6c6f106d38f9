"""Every query with SQL agrees with it; the others keep their invariants."""

import oracle
import pytest

from tempora import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert oracle.difference(spark, sf_dir, registry.queries()[name], SQL[name]) == ""


def test_mmr_is_greedy(spark, sf_dir):
    import numpy as np

    from tempora.plans.selection import mmr_select, scored

    frames = scored(spark, sf_dir).toPandas()
    picked = mmr_select(spark, sf_dir).toPandas()
    for video, group in frames.sort_values("frame_index").groupby("video_id"):
        x, rel = np.stack(group["embedding"]).astype(float), group["score"].to_numpy()
        chosen = [int(rel.argmax())]
        for _ in range(min(6, len(x)) - 1):
            gain = [-np.inf if i in chosen else 0.6 * rel[i] - 0.4 * max(x[i] @ x[j] for j in chosen) for i in range(len(x))]
            chosen.append(int(np.argmax(gain)))
        assert picked[picked.video_id == video].sort_values("pick").frame_index.tolist() == group.frame_index.to_numpy()[chosen].tolist()


def test_bootstrap_holds_the_difference(spark, sf_dir):
    from tempora.plans.statistics import paired_bootstrap

    for r in paired_bootstrap(spark, sf_dir).collect():
        assert r.resamples == 2000 and r.low <= r.mean <= r.high


def test_needle_programs(spark, sf_dir):
    from tempora.plans.programs import needle_accuracy

    rows = {r.program: r for r in needle_accuracy(spark, sf_dir).collect()}
    assert all(r.videos == 200 and r.frames <= 200 * 10 for r in rows.values())
    assert rows["retrieved"].correct > rows["first"].correct
