import random

from chains import AA, BB, CC, HEADERS, RECEIPTS, TRANSFER, header, item, rows, transfer, tx
from eventloom.config import ContractMapping, JobConfig
from eventloom.functions.bloom import bloom_has, bloom_of_bits, event_gate, mapping_gate
from eventloom.functions.keccak import bloom_bits, bloom_bits_column
from eventloom.operators.decode import decode
from eventloom.operators.transfers import native_transfers
from pyspark.sql import functions as F

OTHER = item("Other", ("v", "uint256", False))


def bloom_of(items):
    bloom = bytearray(256)
    for i in items:
        for bit in bloom_bits(i):
            bloom[255 - bit // 8] |= 1 << bit % 8
    return bloom


def holds(bloom, i):
    return all(bloom[255 - bit // 8] & 1 << bit % 8 for bit in bloom_bits(i))


def random_items(seed, n):
    random.seed(seed)
    return ["0x" + random.randbytes(random.choice([20, 32])).hex() for _ in range(n)]


def test_membership_matches_brute_force(spark):
    contents = [random_items(s, n) for s, n in enumerate([0, 1, 5, 40, 200, 600])]
    contents[2] = contents[2] + [AA, TRANSFER.topic0]
    headers = spark.createDataFrame(
        [header(b, bloom_of(items)) for b, items in enumerate(contents)], HEADERS
    )
    asked = [AA, TRANSFER.topic0, *contents[1], *contents[3][:5], *random_items(99, 5)]
    found = headers.orderBy("block_number").select(*[F.expr(bloom_has("logs_bloom", i)) for i in asked]).collect()
    for b, row in enumerate(found):
        bloom = bloom_of(contents[b])
        assert list(row) == [holds(bloom, i) for i in asked]
        assert all(hit for i, hit in zip(asked, row) if i in contents[b])


def test_missing_bloom_admits_nothing(spark):
    headers = spark.createDataFrame([header(1)], HEADERS)
    assert headers.select(F.expr(bloom_has("logs_bloom", AA))).first()[0] is False


def test_bloom_built_by_spark(spark):
    items = random_items(7, 300)
    df = spark.createDataFrame([(n % 3, i) for n, i in enumerate(items)], "block int, item string")
    bits = df.select("block", F.explode(bloom_bits_column(F.col("item"))).alias("bit"))
    built = dict(bits.groupBy("block").agg(bloom_of_bits(F.col("bit"))).collect())
    for block in range(3):
        assert bytes(built[block]) == bytes(bloom_of(items[block::3]))


def test_gates(spark):
    blooms = [
        [AA, TRANSFER.topic0],
        [BB, TRANSFER.topic0],
        [AA, OTHER.topic0],
        [AA],
        [CC, OTHER.topic0, TRANSFER.topic0],
    ]
    headers = spark.createDataFrame([header(b, bloom_of(i)) for b, i in enumerate(blooms)], HEADERS)
    some = ContractMapping((TRANSFER, OTHER), (AA, BB))
    every = ContractMapping((TRANSFER,))
    found = headers.orderBy("block_number").select(
        *map(F.expr, (mapping_gate(some), mapping_gate(every), event_gate(some, OTHER)))
    )
    assert [tuple(r) for r in found.collect()] == [
        (True, True, False),
        (True, True, False),
        (True, False, True),
        (False, False, False),
        (False, True, False),
    ]


def test_a_closed_gate_hides_logs_and_transfers(spark):
    """The header decides: logs its bloom denies are not looked at."""
    receipts = spark.createDataFrame(
        [tx(b, 0, [transfer(AA, 1, 2, 10 + b)], value=str(b + 1)) for b in range(3)], RECEIPTS
    )
    blooms = [[AA, TRANSFER.topic0], [AA, OTHER.topic0], []]
    headers = spark.createDataFrame([header(b, bloom_of(i)) for b, i in enumerate(blooms)], HEADERS)
    mapping = ContractMapping((TRANSFER, OTHER), (AA,))
    config = JobConfig(mappings=(mapping,))
    tables = decode(receipts, headers, config.events())
    assert rows(tables["transfer"], "value") == [("10",)]
    # Block 1 passes the mapping's gate through its other event, so its transfer counts.
    assert rows(native_transfers(receipts, headers, [mapping]), "value") == [("1",), ("2",)]
