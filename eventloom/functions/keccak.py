"""Keccak-256 for a whole Arrow batch at a time.

Spark has no Keccak function. It is needed for three things only: the signature
id of an event (once per event, on the driver), the bit positions of a header
bloom (once per filtered value, on the driver) and the checksummed form of an
address (an Arrow column).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# Tasks receive this module inside the function, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANES = 25
RATE = 136


def _round_constants() -> list[int]:
    register, constants = 1, []
    for _ in range(24):
        constant = 0
        for j in range(7):
            if register & 1:
                constant |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        constants.append(constant)
    return constants


def _lane_route() -> list[tuple[int, int, int]]:
    """(source lane, target lane, rotation) of the combined rho and pi steps."""
    route, x, y = [(0, 0, 0)], 1, 0
    for t in range(24):
        target = y + 5 * ((2 * x + 3 * y) % 5)
        route.append((x + 5 * y, target, (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return route


ROUND_CONSTANTS = _round_constants()
LANE_ROUTE = _lane_route()


def _rotate(lane: np.ndarray, by: int) -> np.ndarray:
    if by == 0:
        return lane
    return (lane << np.uint64(by)) | (lane >> np.uint64(64 - by))


def _permute(state: list[np.ndarray]) -> list[np.ndarray]:
    for constant in ROUND_CONSTANTS:
        parity = [state[x] ^ state[x + 5] ^ state[x + 10] ^ state[x + 15] ^ state[x + 20] for x in range(5)]
        mix = [parity[(x - 1) % 5] ^ _rotate(parity[(x + 1) % 5], 1) for x in range(5)]
        moved: list[np.ndarray] = [state[0]] * LANES
        for source, target, by in LANE_ROUTE:
            moved[target] = _rotate(state[source] ^ mix[source % 5], by)
        state = [
            moved[i] ^ (~moved[i - i % 5 + (i + 1) % 5] & moved[i - i % 5 + (i + 2) % 5])
            for i in range(LANES)
        ]
        state[0] = state[0] ^ np.uint64(constant)
    return state


def keccak256_rows(messages: np.ndarray) -> np.ndarray:
    """Digest of every row of a (rows, length) byte matrix, as (rows, 32) bytes."""
    rows, length = messages.shape
    blocks = length // RATE + 1
    padded = np.zeros((rows, blocks * RATE), dtype=np.uint8)
    padded[:, :length] = messages
    padded[:, length] ^= 0x01
    padded[:, -1] ^= 0x80
    words = padded.view("<u8").astype(np.uint64)
    state = [np.zeros(rows, dtype=np.uint64) for _ in range(LANES)]
    for b in range(blocks):
        for lane in range(RATE // 8):
            state[lane] = state[lane] ^ words[:, b * (RATE // 8) + lane]
        state = _permute(state)
    return np.stack(state[:4], axis=1).astype("<u8").view(np.uint8)


def keccak256(message: bytes) -> bytes:
    return keccak256_rows(np.frombuffer(message, dtype=np.uint8)[None, :]).tobytes()


def bloom_bits(item: str) -> list[int]:
    """The three bits an address or topic sets in a 2048-bit header bloom."""
    digest = keccak256(bytes.fromhex(item.removeprefix("0x")))
    return [(digest[i] << 8 | digest[i + 1]) & 2047 for i in (0, 2, 4)]


def bloom_bits_of(items: Sequence[str]) -> np.ndarray:
    """The three bits of each of many items of one length, hashed as one batch."""
    digest = keccak256_rows(_hex_matrix(pd.Series(items))).astype(np.int64)
    return (digest[:, 0:6:2] << 8 | digest[:, 1:6:2]) & 2047


def _hex_matrix(values: pd.Series) -> np.ndarray:
    joined = bytes.fromhex("".join(v[2:] for v in values))
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(values), -1)


def _bloom_bits_batch(items: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(items)
    distinct = pd.Series(distinct)
    bits = np.zeros((len(distinct) + 1, 3), dtype=np.int32)
    for _, same_length in distinct.groupby(distinct.str.len()):
        digest = keccak256_rows(_hex_matrix(same_length)).astype(np.int32)
        bits[same_length.index] = (digest[:, 0:6:2] << 8 | digest[:, 1:6:2]) & 2047
    rows = pd.Series(list(bits[codes]))
    return rows.where(pd.Series(codes) >= 0, None)


def _checksum_batch(addresses: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(addresses)
    if not len(distinct):
        return pd.Series([None] * len(addresses), dtype=object)
    text = np.frombuffer("".join(a[2:].lower() for a in distinct).encode(), dtype=np.uint8)
    text = text.reshape(len(distinct), 40)
    digest = keccak256_rows(text)[:, :20]
    nibbles = np.stack([digest >> 4, digest & 15], axis=2).reshape(len(distinct), 40)
    raised = np.where((nibbles >= 8) & (text >= ord("a")), text - 32, text).astype(np.uint8)
    shown = ["0x" + row.tobytes().decode() for row in raised] + [None]
    return pd.Series([shown[c] for c in codes], dtype=object)


def bloom_bits_column(item: Column) -> Column:
    """Bloom bits of a hex column; each batch hashes its distinct values once."""
    return F.pandas_udf(_bloom_bits_batch, T.ArrayType(T.IntegerType()))(item)


def checksum_address(address: Column) -> Column:
    """EIP-55 form of a lowercase address column; each batch hashes its distinct values once."""
    return F.pandas_udf(_checksum_batch, T.StringType())(address)
