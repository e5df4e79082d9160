"""Hand-made chain tables and a slow, plain-Python answer to compare with."""

from eventloom.config import AbiInput, AbiItem

AA, BB, CC = ("0x" + c * 20 for c in ("aa", "bb", "cc"))
RECEIPTS = (
    "block_number bigint, transaction_index bigint, tx_hash string, `from` string, `to` string, "
    "value string, logs array<struct<address:string,topics:array<string>,data:string>>"
)
SPLIT = RECEIPTS + ", block_log_start bigint, first_log bigint, whole boolean"
HEADERS = "block_number bigint, block_hash string, timestamp bigint, logs_bloom binary"


def item(name, *inputs, patterns=()):
    patterns = dict(patterns)
    return AbiItem(name, tuple(AbiInput(n, t, i, patterns.get(n)) for n, t, i in inputs))


TRANSFER = item("Transfer", ("from", "address", True), ("to", "address", True), ("value", "uint256", False))


def word(n):
    return format(n % 2**256, "064x")


def transfer(address, sender, receiver, value):
    return (address, [TRANSFER.topic0, "0x" + word(sender), "0x" + word(receiver)], "0x" + word(value))


def tx(block, index, logs, value="0", to=AA):
    return (block, index, f"0x{block * 1000 + index:064x}", "0x" + "01" * 20, to, value, logs)


def header(block, bloom=None):
    return (block, f"0x{block:064x}", 1_600_000_000 + 12 * block, bloom)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
