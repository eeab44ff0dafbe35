"""Plans of the mix stay small: the driver holds every broadcast of a plan at once."""

from canopyframe.llm import kd_shards, pareto_mix


def test_cuts_do_not_repeat_earlier_broadcasts(spark, monkeypatch):
    seen, real = [], pareto_mix.cut_lineage

    def watched(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin"))
        return real(df)
    monkeypatch.setattr(pareto_mix, "cut_lineage", watched)
    docs = spark.range(120).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "repeat('word ', cast(id % 17 as int)) as text")
    pareto_mix.mix(docs).count()
    assert max(seen) <= 6


def test_levels_of_the_shard_tree_do_not_repeat_earlier_broadcasts(spark):
    docs = spark.range(120).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "repeat('word ', cast(id % 17 as int)) as text")
    out = kd_shards.kd_shards(docs, 24)
    # the names of the leaves and the starts of the buckets are left
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
