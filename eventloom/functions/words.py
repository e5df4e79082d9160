"""Decoding of 32-byte ABI words, as Spark SQL expressions over 64 hex characters.

A word is named by a SQL operand: a column, or a field of a lambda variable, so
that the same text serves a projection and a filter inside an array. Words come
without ``0x`` and in lowercase; narrow types look only at their own low bytes.
Nothing here leaves the JVM.
"""

from __future__ import annotations

from eventloom.config import INTEGER_TYPES, spark_type

ZERO_WORD = "0" * 64
# The largest word stands for "no limit" in most allowances, so it gets a shortcut.
FULL_WORD = "f" * 64

# Digits of 2^192, 2^128, 2^64 and 1 in base 10^18, one row per digit, lowest first.
POWER_DIGITS = [
    [2 ** (64 * k) // 10 ** (18 * j) % 10**18 for k in (3, 2, 1, 0)] for j in range(5)
]
POWERS = "array({})".format(
    ", ".join(
        "array({})".format(", ".join(f"CAST({c}BD AS DECIMAL(18,0))" for c in row)) for row in POWER_DIGITS
    )
)
BASE = f"CAST({10**18}BD AS DECIMAL(19,0))"
ZERO = "CAST(0 AS DECIMAL(38,0))"


def topic_word(topic: str) -> str:
    return f"lower(substring({topic}, 3, 64))"


def data_word(data: str, position: int) -> str:
    return f"lower(substring({data}, {3 + 64 * position}, 64))"


def _low(word: str, digits: int) -> str:
    return f"substring({word}, {65 - digits}, {digits})"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` over a name for ``value``, which is computed once however often it is used."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _quarter(word: str, start: int | str) -> str:
    """The 64-bit quarter of a word that starts at a character position."""
    return f"CAST(conv(substring({word}, {start}, 16), 16, 10) AS DECIMAL(20,0))"


def _wide_text(word: str) -> str:
    """Decimal text of a 256-bit unsigned word.

    Each base-10^18 digit before carrying is a sum of four products below
    1.9e19 * 1e18, so it fits DECIMAL(38); one fold over the five digits carries.
    """
    quarters = f"transform(array(1, 17, 33, 49), q_start -> {_quarter(word, 'q_start')})"
    digits = _bound(
        quarters,
        "quarters",
        f"""transform({POWERS}, power -> aggregate(
            zip_with(quarters, power, (q, c) -> q * c), {ZERO},
            (total, product) -> CAST(total + product AS DECIMAL(38,0))))""",
    )
    return f"""aggregate({digits}, struct({ZERO} AS carry, '' AS text),
        (state, digit) -> struct(
            CAST((digit + state.carry - (digit + state.carry) % {BASE}) / {BASE} AS DECIMAL(38,0)) AS carry,
            concat(lpad(CAST(CAST((digit + state.carry) % {BASE} AS DECIMAL(18,0)) AS STRING), 18, '0'),
                   state.text) AS text),
        state -> trim(LEADING '0' FROM state.text))"""


def unsigned_text(word: str) -> str:
    """Decimal text of an unsigned word, by the cheapest arithmetic its size allows."""
    return f"""CASE
        WHEN substring({word}, 1, 48) = '{"0" * 48}' THEN conv(substring({word}, 49, 16), 16, 10)
        WHEN substring({word}, 1, 32) = '{"0" * 32}' AND substring({word}, 33, 1) < '4'
        THEN CAST({_quarter(word, 33)} * {2**64}BD + {_quarter(word, 49)} AS STRING)
        WHEN {word} = '{FULL_WORD}' THEN '{2**256 - 1}'
        ELSE {_wide_text(word)} END"""


def _is_negative(word: str, bits: int) -> str:
    return f"substring({word}, {65 - bits // 4}, 1) >= '8'"


def _extended(word: str, bits: int, signed: bool) -> str:
    """The low bits of a word, widened back to 256 bits."""
    if bits == 256:
        return word
    pad = 64 - bits // 4
    fill = f"'{'0' * pad}'"
    if signed:
        fill = f"CASE WHEN {_is_negative(word, bits)} THEN '{'f' * pad}' ELSE {fill} END"
    return f"concat({fill}, {_low(word, bits // 4)})"


def _negated(word: str) -> str:
    """Two's complement of a word: trailing zeros stay, the last other digit is 16 minus itself."""
    turned = """concat(
        translate(substring(head, 1, length(head) - 1), '0123456789abcdef', 'fedcba9876543210'),
        translate(substring(head, -1, 1), '123456789abcdef', 'fedcba987654321'))"""
    return f"rpad({_bound(f'''trim(TRAILING '0' FROM {word})''', 'head', turned)}, 64, '0')"


def integer_text(word: str, bits: int, signed: bool) -> str:
    """Decimal text of an ABI integer."""
    if bits <= 64:
        plain = f"conv({_low(word, bits // 4)}, 16, 10)"
        if not signed:
            return plain
        extended = f"concat('{'f' * (16 - bits // 4)}', {_low(word, bits // 4)})"
        return f"CASE WHEN {_is_negative(word, bits)} THEN conv({extended}, 16, -10) ELSE {plain} END"
    full = _extended(word, bits, signed)
    if not signed:
        return unsigned_text(full)
    magnitude = _bound(_negated(full), "magnitude", unsigned_text("magnitude"))
    return f"""CASE WHEN {_is_negative(word, bits)} THEN concat('-', {magnitude})
        ELSE {unsigned_text(full)} END"""


# A wide word in steps of plain columns: chunks of 56 bits, each two limbs of 28, and digits of base 10^9.
CHUNKS = 5
CHUNK_DIGITS = 14
LIMB_BITS = 28
DIGITS = 9
LIMB = 10**DIGITS
GROUPS = 9


def is_wide(abi_type: str) -> bool:
    """Whether a value may need more than 64 bits, so that its word is decoded in steps."""
    return abi_type in INTEGER_TYPES and INTEGER_TYPES[abi_type][1] > 64


def _ones(word: str, bits: int, signed: bool) -> str:
    """1 for a negative word, whose size is its complement plus one; else 0."""
    return f"CASE WHEN {_is_negative(word, bits)} THEN 1 ELSE 0 END" if signed else "0"


def _small(size: str) -> str:
    return f"substring({size}, 1, 48) = '{'0' * 48}'"


def _medium(size: str) -> str:
    return f"substring({size}, 1, 32) = '{'0' * 32}' AND substring({size}, 33, 1) < '4'"


def wide_steps(words: dict[str, tuple[bool, int]]) -> list[dict[str, str]]:
    """Columns that the texts of wide integers are made of, a step at a time; each step reads the one before.

    ``words`` names the inputs, whose words stand in columns ``_name``, with sign and bits. Columns
    are computed once and stay in generated code; nothing is computed for a word that fits 126 bits.
    A group of nine decimal digits before carrying is a sum of ten products below 2^28 * 10^9.
    """
    sizes, chunks, groups = {}, {}, {}
    for name, (signed, bits) in words.items():
        word = f"`_{name}`"
        size = _extended(word, bits, signed)
        if signed:
            turned = f"translate({size}, '0123456789abcdef', 'fedcba9876543210')"
            size = f"CASE WHEN {_is_negative(word, bits)} THEN {turned} ELSE {size} END"
        sizes[f"size of {name}"] = size
        size = f"`size of {name}`"
        for c in range(CHUNKS):
            end = 64 - CHUNK_DIGITS * c
            start = max(1, end - CHUNK_DIGITS + 1)
            digits = f"substring({size}, {start}, {end - start + 1})"
            chunks[f"chunk {c} of {name}"] = (
                f"CASE WHEN NOT ({_medium(size)}) AND {size} <> '{FULL_WORD}' THEN CAST(conv({digits}, 16, 10) AS BIGINT) END"
            )
        limbs = []
        for c in range(CHUNKS):
            chunk = f"`chunk {c} of {name}`"
            limbs += [f"({chunk} & {2**LIMB_BITS - 1}L)", f"shiftright({chunk}, {LIMB_BITS})"]
        for g in range(GROUPS):
            factors = [2 ** (LIMB_BITS * k) // LIMB**g % LIMB for k in range(len(limbs))]
            terms = [f"{limb} * {f}L" if f > 1 else limb for limb, f in zip(limbs, factors) if f]
            groups[f"group {g} of {name}"] = " + ".join([*terms, _ones(word, bits, signed)] if g == 0 else terms)
    return [sizes, chunks, groups]


def wide_text(name: str, signed: bool, bits: int) -> str:
    """Decimal text of a wide integer over the columns of its steps, by the cheapest arithmetic its size allows."""
    size, word = f"`size of {name}`", f"`_{name}`"
    one = _ones(word, bits, signed)
    total, parts = "", []
    for g in range(GROUPS):
        group = f"`group {g} of {name}`"
        total = f"({group} + {total} DIV {LIMB}L)" if total else group
        parts.append(f"lpad(CAST({total} % {LIMB}L AS STRING), {DIGITS}, '0')")
    text = f"""CASE
        WHEN {_small(size)} THEN CAST(CAST(conv(substring({size}, 49, 16), 16, 10) AS DECIMAL(20,0)) + {one} AS STRING)
        WHEN {_medium(size)} THEN CAST({_quarter(size, 33)} * {2**64}BD + {_quarter(size, 49)} + {one} AS STRING)
        WHEN {size} = '{FULL_WORD}' THEN '{2**256 - 1}'
        ELSE trim(LEADING '0' FROM concat({', '.join(reversed(parts))})) END"""
    return f"concat(CASE WHEN {_is_negative(word, bits)} THEN '-' ELSE '' END, {text})" if signed else text


def _dynamic_text(word: str, prefix: str) -> str:
    # One word can hold a dynamic value only when it is all zero: an empty one.
    return f"CASE WHEN {word} = '{ZERO_WORD}' THEN '' ELSE concat('{prefix}', {word}) END"


def word_text(abi_type: str, word: str) -> str:
    """The decoded value of a word as text; unknown types keep their hex."""
    if abi_type in INTEGER_TYPES:
        signed, bits = INTEGER_TYPES[abi_type]
        return integer_text(word, bits, signed)
    if abi_type == "address":
        return f"concat('0x', {_low(word, 40)})"
    if abi_type == "bool":
        return f"CASE WHEN {word} <> '{ZERO_WORD}' THEN 'true' ELSE 'false' END"
    if abi_type == "bytes":
        return _dynamic_text(word, "")
    if abi_type == "string":
        return _dynamic_text(word, "0x")
    return f"concat('0x', {word})"


def word_value(abi_type: str, word: str) -> str:
    """The decoded value of a word in its table type."""
    return f"CAST({word_text(abi_type, word)} AS {spark_type(abi_type).simpleString()})"
