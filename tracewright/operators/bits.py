"""Bit fields of payloads as column expressions, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def big_words(payload: Column, count: int) -> list[Column]:
    """The first `count` 8-byte words, big-endian, of a payload padded with zeros."""
    text = F.rpad(F.hex(payload), 16 * count, "0")

    def half(at: int) -> Column:
        return F.conv(F.substring(text, at, 8), 16, 10).cast("bigint")

    return [F.shiftleft(half(16 * k + 1), 32).bitwiseOR(half(16 * k + 9)) for k in range(count)]


def swap(word: Column) -> Column:
    """The word with its eight bytes reversed."""
    for bits, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask).cast("bigint")
        word = F.shiftrightunsigned(word, bits).bitwiseAND(m).bitwiseOR(F.shiftleft(word.bitwiseAND(m), bits))
    return word


def with_words(frame, payload: str = "payload", count: int = 1, names: tuple[str, str] = ("_le", "_be")):
    """Adds two arrays of words, little- and big-endian, one spare zero word at the end."""
    big = big_words(F.col(payload), count)
    frame = frame.select("*", *[w.alias(f"_w{k}") for k, w in enumerate(big)])
    zero = F.lit(0).cast("bigint")
    words = [F.col(f"_w{k}") for k in range(count)]
    frame = frame.withColumns({names[0]: F.array(*[swap(w) for w in words], zero), names[1]: F.array(*words, zero)})
    return frame.drop(*[f"_w{k}" for k in range(count)])


def field_sql(le: str, be: str, first: str, length: str, big: str, signed: str) -> str:
    """SQL of a field's raw BIGINT: a bit pattern if it is unsigned and 64 bits long."""
    word, at = f"({first} div 64)", f"({first} % 64)"
    mask = f"shiftrightunsigned(-1L, 64 - {length})"
    low = f"shiftrightunsigned(get({le}, {word}), {at})"
    high = f"if({at} > 0 and {at} + {length} > 64, shiftleft(get({le}, {word} + 1), 64 - {at}), 0L)"
    little = f"(({low} | {high}) & {mask})"
    over = f"({at} + {length} - 64)"
    within = f"shiftrightunsigned(get({be}, {word}), 64 - {at} - {length})"
    across = f"(shiftleft(get({be}, {word}), {over}) | shiftrightunsigned(get({be}, {word} + 1), 64 - {over}))"
    motorola = f"(if({over} <= 0, {within}, {across}) & {mask})"
    raw = f"if({big}, {motorola}, {little})"
    return f"cast(if({signed}, shiftright(shiftleft({raw}, cast(64 - {length} as int)), cast(64 - {length} as int)), {raw}) as bigint)"


def unsigned_double(raw: Column) -> Column:
    """A 64-bit pattern as an unsigned number, rounded once."""
    low = raw.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).cast("double")
    return F.shiftrightunsigned(raw, 32).cast("double") * F.lit(2.0**32) + low


def float_of_bits(raw: Column, length: Column) -> Column:
    """The IEEE half, single or double whose bits are raw; every step is exact in float64."""

    def of(exponent_bits: int, mantissa_bits: int) -> Column:
        sign = F.when(F.shiftrightunsigned(raw, exponent_bits + mantissa_bits).bitwiseAND(F.lit(1).cast("bigint")) == 1, -1.0).otherwise(1.0)
        exponent = F.shiftrightunsigned(raw, mantissa_bits).bitwiseAND(F.lit((1 << exponent_bits) - 1).cast("bigint"))
        mantissa = raw.bitwiseAND(F.lit((1 << mantissa_bits) - 1).cast("bigint")).cast("double")
        bias, top = (1 << (exponent_bits - 1)) - 1, (1 << exponent_bits) - 1
        small = mantissa * F.lit(2.0 ** (1 - bias - mantissa_bits))
        normal = (F.lit(1.0) + mantissa * F.lit(2.0**-mantissa_bits)) * F.pow(F.lit(2.0), (exponent - bias).cast("double"))
        special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(NAN))
        return sign * F.when(exponent == 0, small).when(exponent == top, special).otherwise(normal)

    return F.when(length == 16, of(5, 10)).when(length == 32, of(8, 23)).when(length == 64, of(11, 52)).otherwise(F.lit(NAN))


def bits_of_float(value: Column, length: Column) -> Column:
    """The bits of the IEEE half, single or double nearest to the value (ties to even); NULL where it is too large.

    Every step is exact in float64: the value is scaled by powers of two until its last kept bit is 1.
    """

    def of(exponent_bits: int, mantissa_bits: int) -> Column:
        bias = (1 << (exponent_bits - 1)) - 1
        size = F.abs(value)
        guess = F.floor(F.log2(F.greatest(size, F.lit(5e-324)))).cast("int")
        two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
        # the logarithm may be off by one near powers of two, and a power below 2^-1022 loses bits: two halves
        times = lambda x, e: x * two(F.floor(e / 2)) * two(e - F.floor(e / 2))
        high = F.when(times(size, -guess) >= 2, guess + 1).when(times(size, -guess) < 1, guess - 1).otherwise(guess)
        exponent = F.greatest(high, F.lit(1 - bias))
        scaled = F.rint(times(size, F.lit(mantissa_bits) - exponent)).cast("bigint")  # with the leading one, if normal
        hidden = F.lit(1 << mantissa_bits).cast("bigint")
        # the leading one of a normal number carries into the exponent field, and so does rounding up
        field = F.shiftleft((exponent + bias - 1).cast("bigint"), mantissa_bits) + scaled
        whole = F.when(size == 0, F.lit(0).cast("bigint")).when(scaled < hidden, scaled).otherwise(field)
        top = F.lit(((1 << exponent_bits) - 1) << mantissa_bits).cast("bigint")
        sign = F.when((value < 0) | (F.signum(value).cast("string") == "-0.0"), F.shiftleft(F.lit(1).cast("bigint"), exponent_bits + mantissa_bits)).otherwise(F.lit(0).cast("bigint"))
        return F.when(whole < top, whole.bitwiseOR(sign))

    return F.when(length == 16, of(5, 10)).when(length == 32, of(8, 23)).when(length == 64, of(11, 52))
