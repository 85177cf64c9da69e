"""Plans of connected components stay small, as each join in them costs the driver memory and threads."""

import random

from offerlane.llm import components


def test_no_part_of_a_round_is_planned_again(spark, monkeypatch):
    joins, kept = [], components.checkpointed

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return kept(df)

    monkeypatch.setattr(components, "checkpointed", counted)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + rng.randrange(300)) for _ in range(400)]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 101)} | {(b, 500) for _, b in edges[100:] if b != 500}
    assert max(joins) == 3, joins
