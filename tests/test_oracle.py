import pytest
from pyspark.sql import functions as F

from pairgauge.functions import text as X
from pairgauge.functions import trees, xml
from pairgauge.operators import formats, generators


def _scored(spark):
    return formats.oracle(generators.fixtures(spark).withColumnRenamed("source", "src"))


def test_fixtures(spark):
    scored = _scored(spark)
    counts = {r.category: r["count"] for r in scored.groupBy("category").count().collect()}
    assert sum(counts.values()) >= 250 and len(counts) >= 16 and scored.select("id").distinct().count() == sum(counts.values())
    assert (counts["gap_fine"], counts["gap_wrong"], counts["after_inline"]) == (160, 80, 150)
    assert generators.unmet_expectations(scored).collect() == []
    # the check itself finds what is wrong
    wrong = scored.filter("id IN ('gap/none/:/0', 'gap/char/:/0')").withColumn("oracle_reward", F.lit(0.5))
    assert sorted(tuple(r.unmet) for r in generators.unmet_expectations(wrong).collect()) == [("reward",), ("reward", "below")]


def test_fixer_raises_and_never_lowers(spark):
    before = _scored(spark).filter("gate_passed")
    after = formats.oracle(before.select("id", "src", xml.fix_aligned(F.col("hyp")).alias("hyp"))).select("id", F.col("oracle_reward").alias("a"))
    r = before.select("id", "category", F.col("oracle_reward").alias("b")).join(after, "id").groupBy("category")
    got = {x.category: x for x in r.agg(F.count_if(F.col("a") > F.col("b")).alias("up"), F.count_if(F.col("a") < F.col("b")).alias("down"), F.min("a").alias("least")).collect()}
    assert all(x.down == 0 for x in got.values())
    assert got["gap_wrong"].up == 80 and got["gap_wrong"].least == 1.0 and got["after_inline"].up == 50 and got["run_of_marks"].least == 1.0


def test_generated_targets_score_one(spark):
    pairs = generators.synthetic_pairs(spark, 80).unionByName(generators.mixed_pairs(spark, 60))
    assert generators.failing_targets(pairs).count() == 0
    repairs = generators.repair_pairs(pairs, 20)
    assert repairs.count() == 20 and generators.noop_pairs(pairs, 20).filter("source_xml = target_xml").count() == 20
    spoiled = pairs.withColumn("target_xml", F.when(F.col("i") % 2 == 0, F.replace("target_xml", F.lit(trees.NBSP), F.lit(" "))).otherwise(F.col("target_xml")))
    assert {r.i % 2 for r in generators.repair_pairs(spoiled, 20).collect()} == {1} == {r.i % 2 for r in generators.noop_pairs(spoiled, 20).collect()}
    with pytest.raises(Exception, match="500 pairs asked for, found"):
        generators.repair_pairs(pairs, 500).collect()
    fixed = repairs.select(X.expand_nbsp(xml.fix_aligned(F.col("source_xml"))).alias("f"), "target_xml").filter("f != target_xml").count()
    assert fixed == 0


def test_fixer_keeps_raw_bytes():
    n = trees.NBSP
    assert trees.fix_aligned("<t>a&amp;b : c</t>") == f"<t>a&amp;b{n}: c</t>"
    assert trees.fix_aligned("<t>a<b> : </b>x</t>") == f"<t>a<b>{n}: </b>x</t>"
    assert trees.fix_aligned("<t>a<b>") == "<t>a<b>"
    assert trees.fix_aligned("<t><codeph>a:b</codeph> c&#32;?</t>") == f"<t><codeph>a:b</codeph> c&#32;{n}?</t>"


def test_scalar_and_sql_functions_agree(spark):
    xml.register(spark)
    cases = generators.fixtures(spark).withColumnRenamed("source", "src")
    formats.oracle(cases).select("id", "src", "hyp", "oracle_reward").createOrReplaceTempView("scored")
    assert spark.sql("select * from scored where xml_gated_scalar(src, hyp) <> oracle_reward").count() == 0
    assert spark.sql("select xml_chrf('a b', 'a b') c, xml_decode_mapped('a&amp;b') d").first() == (100.0, ("a&b", [(0, 1), (1, 6), (6, 7)]))
