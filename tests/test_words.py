import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chains import word
from eventloom.config import INTEGER_TYPES
from __spark_entry__ import SMALL
from eventloom.functions.words import data_word, topic_word, wide_steps, wide_text, word_text, word_value
from eventloom.queries import QUERIES


def decoded(spark, abi_type, words, build=word_text):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return [r[0] for r in df.select(F.expr(build(abi_type, "w"))).collect()]


def edge_numbers(signed, bits):
    random.seed(bits)
    low, high = (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2**bits - 1)
    picks = {low, high, 0, 1, 10**18, 2**64 - 1, 2**64, 2**126 - 1, 2**126, 2**128 - 1, 2**255, 10**30, -1}
    picks |= {-(10**30), low + 1, high - 1, -(16**20)} | {10 ** (18 * k) for k in range(5)}
    picks |= {random.randrange(low, high + 1) for _ in range(60)}
    picks |= {random.randrange(low, high + 1) >> random.randrange(bits) for _ in range(60)}
    return sorted(n for n in picks if low <= n <= high)


@pytest.mark.parametrize("abi_type", sorted(INTEGER_TYPES))
def test_integers(spark, abi_type):
    signed, bits = INTEGER_TYPES[abi_type]
    numbers = edge_numbers(signed, bits)
    assert decoded(spark, abi_type, [word(n) for n in numbers]) == [str(n) for n in numbers]


@pytest.mark.parametrize("abi_type, kind", [("uint32", int), ("int64", int), ("uint64", Decimal), ("uint128", str)])
def test_table_types_hold_every_value(spark, abi_type, kind):
    signed, bits = INTEGER_TYPES[abi_type]
    numbers = edge_numbers(signed, bits)
    values = decoded(spark, abi_type, [word(n) for n in numbers], word_value)
    assert all(type(v) is kind for v in values)
    assert [int(v) for v in values] == numbers


def test_narrow_types_ignore_high_bytes(spark):
    dirty = "f" * 24 + "12" * 20
    assert decoded(spark, "address", [dirty]) == ["0x" + "12" * 20]
    assert decoded(spark, "uint8", ["f" * 62 + "07"]) == ["7"]
    assert decoded(spark, "int8", ["0" * 62 + "ff"]) == ["-1"]
    assert decoded(spark, "uint128", ["f" * 32 + "0" * 31 + "9"]) == ["9"]


def test_bool(spark):
    assert decoded(spark, "bool", [word(0), word(1), word(2)]) == ["false", "true", "true"]


def test_dynamic_types_in_one_word(spark):
    # The all-zero word as an empty value is a reading of the ABI rules, not a published vector.
    assert decoded(spark, "bytes", [word(5), word(0)]) == [word(5), ""]
    assert decoded(spark, "string", [word(5), word(0)]) == ["0x" + word(5), ""]


@pytest.mark.parametrize("abi_type", ["bytes32", "uint24", "uint256[]", "tuple"])
def test_everything_else_keeps_its_hex(spark, abi_type):
    assert decoded(spark, abi_type, [word(77)]) == ["0x" + word(77)]


def test_words_are_cut_in_order(spark):
    df = spark.createDataFrame([("0x" + word(1) + word(0xAB).upper(),)], "d string")
    assert df.select(F.expr(data_word("d", 1))).first()[0] == word(0xAB)
    assert df.select(F.expr(topic_word("d"))).first()[0] == word(1)


@pytest.mark.parametrize("abi_type", ["uint128", "int128", "uint256", "int256"])
def test_wide_integers_in_steps_of_columns(spark, abi_type):
    signed, bits = INTEGER_TYPES[abi_type]
    numbers = edge_numbers(signed, bits)
    df = spark.createDataFrame([(word(n), word(-1 - n)) for n in numbers], "_a string, `_b c` string")
    kinds = {"a": (signed, bits), "b c": (False, 256)}
    for step in wide_steps(kinds):
        df = df.withColumns({name: F.expr(text) for name, text in step.items()})
    found = df.select(*[F.expr(wide_text(name, *kind)) for name, kind in kinds.items()]).collect()
    assert [r[0] for r in found] == [str(n) for n in numbers]
    assert [r[1] for r in found] == [str((-1 - n) % 2**256) for n in numbers]


def test_wide_integers_of_a_table_are_generated_code(spark):
    """No function over arrays, which Spark would interpret for every value, stands in the plan."""
    plan = QUERIES["decode_wide"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "zip_with" not in plan
