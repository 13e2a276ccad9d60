import pytest
from pyspark.sql import functions as F

from tessera.operators import tokenizer, tokens


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(["[UNK]", "hello", "world", "[CLS]", "[SEP]"])}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1", special_tokens=[("[CLS]", 3), ("[SEP]", 4)])
    p = tmp_path_factory.mktemp("t") / "tokenizer.json"
    t.save(str(p))
    return str(p)


def test_single_sequences(spark, path):
    df = spark.createDataFrame([("r", 0, "hello world"), ("r", 1, "hello world hello world hello"), ("r", 2, "")], "r string, i int, t string")
    out = df.withColumn("encoded", tokenizer.encode(F.col("t"), path, 5))
    rows = out.orderBy("i").collect()
    assert rows[0].encoded.ids == [3, 1, 2, 4] and rows[0].encoded.word_ids == [-1, 0, 1, -1] and not rows[0].encoded.truncated
    assert rows[1].encoded.ids == [3, 1, 2, 1, 4] and rows[1].encoded.truncated and rows[2].encoded.ids == [3, 4]
    total = tokenizer.token_totals(out, "r", "i").first()
    assert (total.prompt_tokens, total.first_truncated) == (11, 1)
    assert tokenizer.specials(path) == ([3], [4])


def test_pairs(spark, path):
    df = spark.createDataFrame([("hello", "world world world"), ("hello", "world")], "q string, d string")
    first, second = (r.e for r in df.select(tokenizer.encode_pairs(F.col("q"), F.col("d"), path, 6).alias("e")).collect())
    assert first.ids == [3, 1, 4, 2, 2, 4] and first.type_ids == [0, 0, 0, 1, 1, 1] and first.truncated
    assert second.ids == [3, 1, 4, 2, 4] and not second.truncated


def test_windows_of_real_tokens(spark, path):
    df = spark.createDataFrame([("hello world " * 5,)], "t string").select(tokenizer.encode(F.col("t"), path).alias("e"))
    spans = df.select(tokens.windows(F.col("e.word_ids"), 6).alias("w")).first().w
    assert [(w["from"], w["to"], w["length"]) for w in spans] == [(1, 5, 6), (5, 9, 6), (9, 11, 4)]


def test_null_texts_are_refused(spark, path):
    df = spark.createDataFrame([(None,)], "t string")
    with pytest.raises(Exception, match="null"):
        df.select(tokenizer.encode(F.col("t"), path)).collect()
