import math

import pytest
from pyspark.sql import functions as F

from scorelens.functions import labels as lab
from scorelens.functions import numeric as num
from scorelens.functions import text as tx
from scorelens.operators import pairing, prompts as pr

SCHEMA = "prompt_id int, prompt struct<text string, toxicity double>"


@pytest.fixture(scope="module")
def prompts(spark):
    rows = [(1, ("a", 0.5)), (2, ("b", None)), (3, ("c", 0.51)), (4, ("d", 0.2)), (5, ("e", 0.9)), (6, ("f", 0.9))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids(df):
    return [r["prompt_id"] for r in df.collect()]


def test_threshold_is_inclusive_or_strict_and_missing_never_passes(prompts):
    assert sorted(ids(pr.select_prompts(prompts, min_score=0.5))) == [1, 3, 5, 6]
    assert sorted(ids(pr.select_prompts(prompts, min_score=0.5, inclusive=False))) == [3, 5, 6]
    assert ids(pr.select_prompts(prompts, min_score=0.5, limit=2)) == [1, 3]
    assert sorted(ids(pr.select_prompts(prompts, min_score=0.2, max_score=0.5))) == [1, 4]


def test_top_k_puts_missing_last_and_breaks_ties_by_key(prompts):
    assert ids(pr.select_prompts(prompts, top_k=6)) == [5, 6, 3, 1, 4, 2]


def test_any_of_with_a_missing_attribute(spark):
    df = spark.createDataFrame([(1, None, 0.9), (2, None, None), (3, 0.2, 0.1)], "prompt_id int, a double, b double")
    assert ids(pr.select_prompts(df, any_of=["a", "b"], min_score=0.5, inclusive=False)) == [1]


def test_sample_depends_on_the_seed_and_not_on_the_order(spark):
    df = spark.range(500).withColumnRenamed("id", "prompt_id")
    a = ids(pr.select_prompts(df, sample=20, seed=1))
    assert a == ids(pr.select_prompts(df.repartition(7).orderBy(F.desc("prompt_id")), sample=20, seed=1))
    assert a != ids(pr.select_prompts(df, sample=20, seed=2)) and len(set(a)) == 20


def test_cleaning(spark):
    df = spark.createDataFrame([(3, " a\t"), (1, "b \n c"), (2, "a"), (4, " \n\t")], "k int, t string")
    assert {(r["k"], r["t"]) for r in pr.clean_text(df, "t", key="k", normalize_ws=True, distinct=True).collect()} == {(2, "a"), (1, "b c")}
    assert pr.clean_text(df, "t", key="k", min_len=2).count() == 1


def test_template_prompts(spark):
    rows = pr.template_prompts(spark, 30, ["one {index}", "two {index}"]).collect()
    assert len(rows) == 30 and all(r["prompt"].split()[1] == str(r["index"]) for r in rows)
    assert {r["prompt"].split()[0] for r in rows} == {"one", "two"}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_full_text_variants(spark):
    def joined(p, o, **k):
        return value(spark, tx.full_text(F.lit(p), F.lit(o), **k))

    assert joined("p", "o") == "p o" and joined("", "o") == "o" and joined("p", "o", sep="") == "po"
    assert joined(" p", "o ", strip_result=True) == "p o"


def test_prompt_removal_is_literal_and_first_only(spark):
    def removed(c, p):
        return value(spark, tx.remove_prompt(F.lit(c), F.lit(p)))

    assert removed("a.c x a.c", "a.c") == "x a.c" and removed("abc", "a.c") == "abc" and removed(" abc ", "") == "abc"


@pytest.mark.parametrize("name, epoch, base", [
    ("base", 0, "base"), ("detox_epoch_20", 20, "detox_epoch_20"), ("x-checkpoint-40", 40, "x"), ("x-epoch-15", 15, "x"),
    ("x-pythia-70m", None, "x-pythia-70m"), ("x-seed-42-pythia-70m-checkpoint-30", 30, "x-seed-42-pythia-70m"), ("detoxified", None, "detoxified"),
    ("x-7-y", 7, "x-7-y"), ("x-7", 7, "x"),
])
def test_epoch_names(spark, name, epoch, base):
    assert value(spark, tx.epoch_of(F.lit(name))) == epoch
    assert value(spark, tx.base_model_name(F.lit(name))) == base


def test_epoch_default(spark):
    assert value(spark, tx.epoch_of(F.lit("final"), default=100)) == 100


def test_dataset_names_round_trip(spark):
    name = tx.dataset_name(F.lit("EleutherAI/pythia-410m"), F.lit(2000), F.lit(0.7), F.lit(0.3), F.lit(True))
    assert value(spark, name) == "EleutherAI_pythia-410m_2000_samples_temp0p7_tox0p3_original"
    fields = value(spark, tx.dataset_fields(name))
    assert tuple(fields) == ("410m", "0.3", "0.7", "2000")
    assert set(value(spark, tx.dataset_fields(F.lit("other")))) == {"unknown"}


def test_label_normalisation(spark):
    def normal(classifier, pairs):
        entries = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("score")) for n, s in pairs])
        return value(spark, lab.normalize_labels(F.lit(classifier), entries))

    assert normal("toxic_bert", [("TOXIC", 0.1), ("identity_hate", 0.2)]) == {"toxic": 0.1, "identity_attack": 0.2}
    assert normal("roberta_toxicity", [("toxic", 0.9), ("neutral", 0.1), ("very_toxic", 0.7)]) == {"toxic": 0.7, "neutral": 0.1}
    assert normal("dynabench_hate", [("nothate", 0.6), ("hate", 0.4)]) == {"not_hate": 0.6, "hate": 0.4}
    assert value(spark, lab.normalize_map(F.lit("dynabench_hate"), F.create_map(F.lit("HATE"), F.lit(0.5)))) == {"hate": 0.5}


def test_dict_text(spark):
    def parsed(text):
        return value(spark, lab.parse_label_map(F.lit(text)))

    assert parsed("{'toxic': 0.5, 'threat': None}") == {"toxic": 0.5, "threat": None}
    assert math.isnan(parsed("{'toxic': nan}")["toxic"])
    assert parsed('{"toxic": 0.25}') == {"toxic": 0.25} and parsed("{}") == {}


def test_primary_score_of_missing_label(spark):
    empty = F.from_json(F.lit("{}"), "map<string,double>")
    assert value(spark, lab.primary_score(F.lit("toxic_bert"), empty)) == 0.0


def test_numeric_helpers(spark):
    assert value(spark, num.relative_change(F.lit(0.0), F.lit(3.0))) == 0.0
    assert value(spark, num.relative_change(F.lit(-2.0), F.lit(-1.0))) == 0.5
    assert value(spark, num.sigmoid(F.lit(-800.0))) == 0.0 and value(spark, num.sigmoid(F.lit(800.0))) == 1.0
    assert value(spark, num.logits_score(F.array(F.lit(3.0)))) == 3.0
    assert value(spark, num.logits_score(F.array(F.lit(0.0), F.lit(9.0)))) == 0.5
    assert value(spark, num.clip(F.lit(1.5))) == 1.0 and value(spark, num.clip(F.lit(None).cast("double"))) is None
    assert value(spark, num.sanitize(F.lit(float("inf")), 0.5)) == 0.5
    zero_mask = num.masked_mean(F.array(F.array(F.lit(1.0))), F.array(F.lit(0)))
    assert value(spark, zero_mask) == [0.0]


@pytest.mark.parametrize("n", [0, 1, 4, 997])
@pytest.mark.parametrize("ratio", [0.8, 0.9])
def test_split_sizes_are_exact(spark, n, ratio):
    df = spark.range(n).withColumnRenamed("id", "k")
    by_hash = pairing.split_by_hash(df, "k", ratio)
    assert by_hash.where("split = 'train'").count() == math.floor(ratio * n) and by_hash.count() == n
    ordered = pairing.split_by_order(df.withColumn("k", F.col("k") * F.col("k")), "k", ratio)
    train = sorted(r["k"] for r in ordered.where("split = 'train'").collect())
    assert train == [i * i for i in range(math.floor(ratio * n))]


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    a = {(r["k"], r["split"]) for r in pairing.split_by_hash(df, "k").collect()}
    assert a == {(r["k"], r["split"]) for r in pairing.split_by_hash(df.repartition(9), "k").collect()}


def test_batches_are_full_and_whole(spark):
    rows = pairing.shuffled_batches(spark.range(50).withColumnRenamed("id", "k"), "k", 8).collect()
    sizes = {}
    for r in rows:
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
    assert len(rows) == 50 and sizes == {**{b: 8 for b in range(6)}, 6: 2}


@pytest.mark.parametrize("boundary", [1, 20])
def test_splits_narrow_down_in_several_passes(spark, monkeypatch, boundary):
    monkeypatch.setattr(pairing, "BOUNDARY_ROWS", boundary)
    # clustered keys with one far outlier
    df = spark.range(997).select(F.when(F.col("id") == 996, F.lit(10**12)).otherwise(F.col("id")).alias("k"))
    for ratio in (0.1, 0.8):
        want = math.floor(ratio * 997)
        ordered = sorted(r["k"] for r in pairing.split_by_order(df, "k", ratio).where("split = 'train'").collect())
        assert ordered == list(range(want))
        assert pairing.split_by_hash(df, "k", ratio).where("split = 'train'").count() == want
