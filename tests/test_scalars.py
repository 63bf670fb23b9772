import math

import pytest
from pyspark.sql import functions as F

from helixloom.functions import parsers
from helixloom.functions import scalars as S


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_infer_type(spark):
    texts = ["5", " 5 ", "-7", "1_000", "1.0", "5.0", "1e5", ".5", "nan", "-inf", "1f", "a", "", "1__0"]
    assert values(spark, texts, S.infer_type) == [
        "integer", "integer", "integer", "integer", "float", "float", "float", "float", "float", "float", "keyword", "keyword", "keyword", "keyword"]


def test_parse_numbers(spark):
    assert values(spark, ["5", "5.7", "1_000", "x", " 3"], S.parse_int) == [5, None, 1000, None, 3]
    got = values(spark, ["1f", "1e2", "nan", "-inf", "0.5"], S.parse_float)
    assert got[0] is None and got[1] == 100.0 and math.isnan(got[2]) and got[3] == -math.inf and got[4] == 0.5


def test_clean_number(spark):
    assert values(spark, ["nan", "inf", "-inf", "2.5"], lambda c: S.clean_number(S.parse_float(c))) == [None, 999.99, 999.99, 2.5]
    assert values(spark, ["nan"], lambda c: S.clean_number(S.parse_float(c), nan=-999.99)) == [-999.99]


def test_start_end_and_first_position(spark):
    assert [tuple(r) for r in values(spark, ["12-15", "7", "?-15", "12-?"], S.start_end)] == [(12, 15), (7, 7), (None, 15), (12, None)]
    assert values(spark, ["12-15", "?-15", "x"], S.first_position) == [12, 15, None]


def test_pred_score(spark):
    got = [tuple(r) for r in values(spark, ["tolerated(0.12)", "0.3", "deleterious", "low_confidence(1)"], S.pred_score)]
    assert got == [("tolerated", 0.12), (None, 0.3), (None, None), ("low_confidence", 1.0)]


def test_lists_tokens_escapes(spark):
    assert values(spark, ["a&b", ""], lambda c: S.to_list(c, "&")) == [["a", "b"], None]
    assert values(spark, ["Whole_Blood (left)", "Été fort"], S.tokens) == [["whole", "blood", "left"], ["été", "fort"]]
    assert values(spark, ["Whole_Blood (left)"], lambda c: S.tokens(c, "whitespace")) == [["Whole_Blood", "(left)"]]
    assert values(spark, ["a\\x3db\\x3bc\\x2c_d"], S.decode_escapes) == ["a=b;c_d"]


def test_natural_order(spark):
    texts = ["chr10", "chr2", "chr1", "10", "9", "b", "chr2a", "chr02", "99999999999999999999999", "100000000000000000000000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.orderBy(S.natural_key("t"), "t").collect()]
    assert got == ["9", "10", "99999999999999999999999", "100000000000000000000000", "b", "chr1", "chr02", "chr2", "chr2a", "chr10"]


def test_variant_functions(spark):
    df = spark.createDataFrame([("chr1", 100, "ACGTACGTACGT", "A"), ("X", 5, "A", "G"), ("2", 9, "A", ".")], "c string, p int, r string, a string")
    got = [tuple(r) for r in df.select(S.display_id("c", "p", "r", "a"), S.variant_class("r", "a"), S.variant_class("r", "a", "length"), S.normalize_chrom("c")).collect()]
    assert got == [("chr1_100_ACGTACGTAC_A", "INDEL", "INDEL", "1"), ("X_5_A_G", "SNV", "SNV", "X"), ("2_9_A_.", "INDEL", "INDEL", "2")]
    assert values(spark, ["0/1", "1|1", "0/0", "./1", "1"], S.alt_count) == [1, 2, 0, 1, 1]
    assert values(spark, ["chr1_100_A_G", "X_5_A_G"], S.region_string) == ["chr1:75-125", "chrX:-20-30"]
    assert values(spark, ["chr1_100_A_G"], lambda c: S.region_string(c, kind="decipher")) == ["1:75-125/location/1:100-100"]


def test_variant_key_is_sha224_of_all_parts(spark):
    import hashlib

    want = hashlib.sha224(b"1-100-A-G-.-ds").hexdigest()
    got = spark.sql("SELECT '1' c, 100 p, 'A' r, 'G' a, cast(null as string) i").select(S.variant_key("c", "p", "r", "a", "i", F.lit("ds"))).first()[0]
    assert got == want


def test_parsers_and_dictionaries(spark):
    parsers.register_parser("upper", F.upper)
    assert values(spark, ["a"], parsers.parser("upper")) == ["A"]
    with pytest.raises(KeyError):
        parsers.parser("unknown")
    assert values(spark, ["a", "z", None], lambda c: parsers.map_values(c, {"a": "b"})) == ["b", "z", None]
    assert values(spark, ["7", "z"], lambda c: parsers.map_values(c, {str(i): "x" for i in range(3000)})) == ["x", "z"]


def test_safe_names(spark):
    from helixloom.operators.shaping import safe_names

    assert safe_names(spark.sql("SELECT 1 AS `Gene.refGene`, 2 AS x")).columns == ["Gene_refGene", "x"]
