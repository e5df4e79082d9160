"""SQL for what no database has: Keccak-256, header blooms and checksummed addresses.

The digest runs as a recursive query, one round a step and one column a lane, so that
hashes, bit layout and false positives are checked without any code of this package but
the round constants and lane routes.
"""

from __future__ import annotations

from functools import reduce

from eventloom.functions.keccak import LANE_ROUTE, RATE, ROUND_CONSTANTS

FULL = (1 << 64) - 1


def _xor(*terms: str) -> str:
    return reduce(lambda a, b: f"xor({a}, {b})", terms)


def _rotated(lane: str, by: int) -> str:
    # Bits that a left shift would push out are masked first: it raises on overflow.
    return lane if by == 0 else f"((({lane} & {FULL >> by}::UBIGINT) << {by}::UBIGINT) | ({lane} >> {64 - by}::UBIGINT))"


def keccak_ctes(source: str) -> str:
    """CTEs up to ``digests(item, digest)``, 24 bytes as hex, of ``source(item, message)``, hex of at most 134 bytes."""

    def lane(j: int) -> str:
        pairs = " || ".join(f"substr(padded, {16 * j + 2 * k + 1}, 2)" for k in range(7, -1, -1))
        return f"('0x' || {pairs})::UBIGINT AS s{j}" if j < RATE // 8 else f"0::UBIGINT AS s{j}"

    def mixed(i: int) -> str:
        x, row = i % 5, i - i % 5
        value = _xor(f"b{i}", f"((~b{row + (x + 1) % 5}) & b{row + (x + 2) % 5})")
        return _xor(value, "constant") if i == 0 else value

    def text(lane: str) -> str:
        return " || ".join(f"substr(lpad(lower(hex({lane})), 16, '0'), {k}, 2)" for k in range(15, 0, -2))

    lanes = range(25)
    parities = ", ".join(f"{_xor(*[f's{x + 5 * y}' for y in range(5)])} AS c{x}" for x in range(5))
    theta = ", ".join(f"{_xor(f's{i}', f'c{(i + 4) % 5}', _rotated(f'c{(i + 1) % 5}', 1))} AS t{i}" for i in lanes)
    moved = ", ".join(f"{_rotated(f't{a}', by)} AS b{b}" for a, b, by in LANE_ROUTE)
    constants = ", ".join(f"({n}, {c}::UBIGINT)" for n, c in enumerate(ROUND_CONSTANTS))
    return f"""kc(n, constant) AS (VALUES {constants}),
kp AS (SELECT item, message || '01' || repeat('0', {2 * RATE - 4} - length(message)) || '80' AS padded FROM {source}),
k AS (SELECT item, 0 AS n, {", ".join(map(lane, lanes))} FROM kp
  UNION ALL SELECT item, n + 1, {", ".join(map(mixed, lanes))} FROM (SELECT item, n, constant, {moved} FROM (
    SELECT item, n, constant, {theta} FROM (SELECT k.*, constant, {parities} FROM k JOIN kc ON k.n = kc.n)))),
digests AS (SELECT item, {text("s0")} || {text("s1")} || {text("s2")} AS digest FROM k WHERE n = 24)"""


def bloom_ctes(wanted: list[str]) -> str:
    """CTEs up to ``admits(block_number, item)``: which of the wanted items each block's bloom admits.

    Stands behind ``raw`` (block_number, address, topic0..topic2).
    """
    items = ", ".join(f"('{i}')" for i in wanted)
    return f"""wanted(item) AS (VALUES {items}),
held AS (SELECT DISTINCT block_number, unnest([address, topic0, topic1, topic2]) AS item FROM raw),
m AS (SELECT item, substr(item, 3) AS message FROM (SELECT item FROM held UNION SELECT item FROM wanted) WHERE item IS NOT NULL),
{keccak_ctes("m")},
bits AS (SELECT DISTINCT item, ('0x' || substr(digest, p, 4))::UBIGINT % 2048 AS bit FROM digests, (VALUES (1), (5), (9)) v(p)),
set_bits AS (SELECT DISTINCT block_number, bit FROM held JOIN bits USING (item)),
admits AS (SELECT block_number, item FROM set_bits JOIN bits USING (bit) WHERE item IN (SELECT item FROM wanted)
  GROUP BY block_number, item HAVING count(*) = (SELECT count(*) FROM bits b WHERE b.item = bits.item)),
blocks AS (SELECT DISTINCT block_number FROM t)"""


def admitted(item: str) -> str:
    return f"(block_number, '{item}') IN (SELECT block_number, item FROM admits)"


def checksummed(address: str, digest: str) -> str:
    """An address with the letters in upper case where the digest's digit is 8 or more."""
    letter = f"substr({address}, i + 2, 1)"
    letters = f"[CASE WHEN {digest}[i] >= '8' THEN upper({letter}) ELSE {letter} END FOR i IN range(1, 41)]"
    return f"'0x' || array_to_string({letters}, '')"
