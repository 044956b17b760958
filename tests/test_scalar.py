import pytest
from pyspark.sql import functions as F

from fathom.functions import prompts as P
from fathom.functions import scalar as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "wanted"), [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0, 0.0], [1.0, 1.0], 0.7071), ([0.0, 0.0], [1.0, 1.0], 0)])
def test_cosine(spark, a, b, wanted):
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(wanted, abs=1e-4)


def test_cosine_of_other_lengths_is_null(spark):
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0]) is None


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("Error at line 42", "Error at line N"), ("Cannot find 'foo'", "Cannot find STR"), ('Cannot find "bar"', "Cannot find STR"), ("Error in /usr/local/file.ts", "Error in PATH"), ("Memory at 0x7fff5fbff8c0", "Memory at NxNfffNfbffNcN"), ("Error   with\n\ttabs", "Error with tabs"), ("a" * 600, "a" * 500)],
)
def test_normalized_errors(spark, text, wanted):
    assert one(spark, S.normalize_error(F.col("t")), t=text) == wanted


def test_signature(spark):
    sign = lambda k, m: one(spark, S.error_signature(F.col("k"), F.col("m")), k=k, m=m)
    assert len(sign("runtime", "x")) == 16 and sign("runtime", "x") == sign("runtime", "x") != sign("build", "x")


@pytest.mark.parametrize(("outcome", "wanted"), [("success", 0.55), ("partial", 0.53), ("failure", 0.35)])
def test_reward(spark, outcome, wanted):
    assert one(spark, S.reward(F.lit(0.5), F.lit(outcome))) == pytest.approx(wanted)


def test_five_failures_stop_at_the_floor(spark):
    log = spark.createDataFrame([(i, "failure") for i in range(5)], "ts int, outcome string").groupBy().agg(S.reward_fold(F.collect_list(F.struct("ts", "outcome"))).alias("s"))
    assert log.first()["s"] == 0.1


def test_rate_and_rounding(spark):
    assert one(spark, S.success_rate(F.lit(7), F.lit(3))) == 0.7
    assert one(spark, S.success_rate(F.lit(0), F.lit(0))) == 0.5
    assert one(spark, S.half_up(F.lit(-2.5), 0)) == -2


@pytest.mark.parametrize(("value", "pattern", "wanted"), [("SRC/a_b", "src/%", True), ("aXb", "a_b", True), ("a%b", "a\\%b", False), ("é", "É", False), ("a\\b", "a\\b", True)])
def test_loose_like(spark, value, pattern, wanted):
    assert one(spark, S.loose_like(F.col("v"), F.col("p")), v=value, p=pattern) is wanted


@pytest.mark.parametrize(
    ("command", "wanted"),
    [("npm install -D typescript@5.0.0 @scope/pkg@^1.2 lodash", ("npm", ["typescript", "@scope/pkg", "lodash"])), ("npm i lodash@latest", ("npm", ["lodash@latest"])), ("pip install requests==2.0", ("pip", ["requests==2.0"])), ("pip install -r requirements.txt", ("pip", ["requirements.txt"])), ("npm install", None), ("sudo npm i x", None)],
)
def test_packages(spark, command, wanted):
    found = one(spark, P.command_packages(F.col("c")), c=command)
    assert (found and (found["ecosystem"], found["packages"])) == wanted


@pytest.mark.parametrize(("prompt", "wanted"), [("fix typo", 1), ("what is OAuth", 2), ("Implement OAuth with Google across the entire codebase", 9)])
def test_prompt_complexity(spark, prompt, wanted):
    assert one(spark, P.prompt_complexity(F.col("p")), p=prompt) == wanted


def test_sensitive_paths(spark):
    kind = lambda p, **k: one(spark, P.sensitive_category(F.col("p"), **k), p=p)
    assert kind("a/.env") == "Environment files" and kind("x/secrets/y") == "Secret directories" and kind("a/b.ts") is None
    assert kind("a/.env.example", allowed=[".env.example"]) is None and kind("a/zz.q", custom=["ZZ"]) == "Custom pattern"
    assert kind("a/.env", off=["Environment files"]) is None


def test_vectors_as_bytes(spark):
    back = spark.createDataFrame([([1.5, -2.0],)], "v array<float>").select(S.decode_vector(S.encode_vector(F.col("v"))).alias("v")).first()["v"]
    assert list(back) == [1.5, -2.0]


def test_prompts_follow_the_rules_of_their_sql(spark, tmp_path):
    import random

    import duckdb

    from fathom.plans.queries import ORACLE, QUERIES

    rng = random.Random(5)
    parts = ["éliste", "élist", "list", "é", "ſse", "sse", "K8s", "k8s", "docs.", "\v", "\n- a", "- b ", " ", "  ", "what\vis", "what is", "stripe", "Express", "next.js", "ünext", "a" * 11, ". ", "!\u0085", "1. ſ", "ONLY a", "the ", "İ", "ı", "\r", "vue", "guide", "apixreference", "api-reference"]
    rows = [(k, k % 5, None if k == 7 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(600)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("prompt_complexity", "doc_queries", "doc_topics"):
        got, rel = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE[name])
        assert sorted(map(tuple, got.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr), name
