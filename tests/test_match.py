import pytest
from pyspark.sql import functions as F

from chains import AA, TRANSFER, item, transfer, word
from eventloom.config import ConfigError, ContractMapping, JobConfig
from eventloom.operators.match import check_patterns, event_matches, java_pattern

LOG = "address string, topics array<string>, data string"


def matches(spark, event, log):
    df = spark.createDataFrame([log], LOG)
    return df.where(event_matches(event)).count() == 1


@pytest.mark.parametrize("topics, fits", [(1, False), (2, False), (3, True), (4, False)])
def test_topic_count(spark, topics, fits):
    values = [TRANSFER.topic0] + ["0x" + word(n) for n in range(3)]
    assert matches(spark, TRANSFER, (AA, values[:topics], "0x" + word(1))) is fits


def test_no_topics_at_all(spark):
    assert not matches(spark, TRANSFER, (AA, [], "0x" + word(1)))


@pytest.mark.parametrize("size", [0, 16, 31, 32, 40, 63, 64])
@pytest.mark.parametrize("inputs", [0, 1, 2])
def test_data_length(spark, size, inputs):
    event = item("E", *[(f"v{n}", "uint256", False) for n in range(inputs)])
    log = (AA, [event.topic0], "0x" + "ab" * size)
    assert matches(spark, event, log) is (size // 32 == inputs)


@pytest.mark.parametrize(
    "name, kind, pattern, value, fits",
    [
        ("v", "uint256", "^12", 1234, True),
        ("v", "uint256", "23", 1234, True),
        ("v", "uint256", "^23", 1234, False),
        ("v", "uint256", "34$", 1234, True),
        ("v", "uint256", r"\d{4}", 1234, True),
        ("v", "address", "ABCD$", 0xABCD, True),
        ("v", "address", "0XABCD", 0xABCD, False),
        ("v", "bool", "TRUE|maybe", 1, True),
        ("v", "bytes32", "'", 1, False),
    ],
)
def test_patterns(spark, name, kind, pattern, value, fits):
    event = item("E", (name, kind, False), patterns={name: pattern})
    assert matches(spark, event, (AA, [event.topic0], "0x" + word(value))) is fits
    event = item("E", (name, kind, True), patterns={name: pattern})
    assert matches(spark, event, (AA, [event.topic0, "0x" + word(value)], "0x")) is fits


@pytest.mark.parametrize("data", [None, "", "0x"])
def test_no_data_has_no_words(spark, data):
    topics = lambda event: [event.topic0, "0x" + word(1)]
    indexed = item("E", ("v", "uint256", True))
    assert matches(spark, indexed, (AA, topics(indexed), data))
    plain = item("E", ("v", "uint256", False))
    assert not matches(spark, plain, (AA, [plain.topic0], data))


@pytest.mark.parametrize(
    "pattern, fits", [("^[[:digit:]]+$", True), ("^[[:alpha:]]+$", False), ("^(?P<n>1)2", True), ("[[:^digit:]]", False)]
)
def test_patterns_of_the_other_syntax(spark, pattern, fits):
    event = item("E", ("v", "uint256", False), patterns={"v": pattern})
    assert matches(spark, event, (AA, [event.topic0], "0x" + word(1234))) is fits


@pytest.mark.parametrize("pattern", ["[a-z--b]", "[a~~b]", "[[:nope:]]"])
def test_patterns_without_a_counterpart_are_refused(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def test_all_patterns_must_match(spark):
    event = item(*[TRANSFER.name], *[(i.name, i.type, i.indexed) for i in TRANSFER.inputs], patterns={"from": "1$", "value": "^7"})
    assert matches(spark, event, transfer(AA, 1, 2, 70))
    assert not matches(spark, event, transfer(AA, 2, 2, 70))
    assert not matches(spark, event, transfer(AA, 1, 2, 8))


def test_only_a_final_dollar_is_the_end(spark):
    assert java_pattern("a$") == r"(?iU)a\z"
    assert java_pattern(r"a\$") == r"(?iU)a\$"
    assert java_pattern(r"a\\$") == r"(?iU)a\\\z"
    df = spark.createDataFrame([("x\n",)], "v string")
    assert df.where(F.col("v").rlike(java_pattern("x$"))).count() == 0


def test_bad_pattern_is_a_config_error(spark):
    event = item("E", ("v", "uint256", False), patterns={"v": "("})
    with pytest.raises(ConfigError):
        check_patterns(spark, JobConfig(mappings=(ContractMapping((event,)),)))
