"""Bytes of small tagged audio files as columns: RIFF chunks, ID3 frames, FLAC comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: nested bodies would repeat their expressions else."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(n: Column | int, width: int, little: bool = False) -> Column:
    """An unsigned integer of ``width`` bytes."""
    if isinstance(n, int):
        return F.unhex(F.lit(n.to_bytes(width, "little" if little else "big").hex()))
    digits = F.lpad(F.hex(n.cast("long")), 2 * width, F.lit("0"))
    places = range(width - 1, -1, -1) if little else range(width)
    return F.unhex(_once(digits, lambda d: F.concat(*[F.substring(d, 2 * k + 1, 2) for k in places])))


def raw(text: Column | str) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8")


def chunk(name: str, body: Column) -> Column:
    """A RIFF chunk, padded to an even length."""
    pad = lambda size: F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return _once(body, lambda b: F.concat(raw(name), number(F.octet_length(b), 4, True), b, pad(F.octet_length(b))))


def wave(*chunks: Column) -> Column:
    return chunk("RIFF", F.concat(raw("WAVE"), *chunks))


def wave_format(rate: int) -> Column:
    """A format chunk of ``rate`` bytes a second."""
    return chunk("fmt ", F.concat(number(1, 2, True), number(1, 2, True), number(rate, 4, True), number(rate, 4, True), number(1, 2, True), number(8, 2, True)))


def info(*pairs: Column) -> Column:
    return chunk("LIST", F.concat(raw("INFO"), *pairs))


def _synchsafe(n: Column) -> Column:
    spread = lambda m: sum((F.shiftleft(F.shiftright(m, 7 * k).bitwiseAND(127).cast("long"), 8 * k) for k in range(1, 4)), m.bitwiseAND(127).cast("long"))
    return number(_once(n, spread), 4)


def frame(name: str, body: Column) -> Column:
    """An ID3 frame of version 2.4."""
    return _once(body, lambda b: F.concat(raw(name), _synchsafe(F.octet_length(b)), F.unhex(F.lit("0000")), b))


def text_frame(name: str, *values: Column | str) -> Column:
    """A frame of UTF-8 texts, parted by zero bytes."""
    parted = [x for v in values for x in (F.unhex(F.lit("00")), raw(v))][1:]
    return frame(name, F.concat(F.unhex(F.lit("03")), *parted))


def id3(*frames: Column) -> Column:
    return _once(F.concat(*frames), lambda b: F.concat(raw("ID3"), F.unhex(F.lit("040000")), _synchsafe(F.octet_length(b)), b))


def flac(seconds: Column, *comments: Column, rate: int = 44100) -> Column:
    """A stream header of that length, and its comments."""
    stream = F.concat(F.unhex(F.lit("00" * 10)), number(F.lit(rate * (1 << 44)) + seconds.cast("long") * rate, 8), F.unhex(F.lit("00" * 16)))
    sized = [_once(raw(c), lambda b: F.concat(number(F.octet_length(b), 4, True), b)) for c in comments]
    body = F.concat(number(4, 4, True), raw("test"), number(len(comments), 4, True), *sized)
    return _once(body, lambda b: F.concat(raw("fLaC"), number(34, 4), stream, F.unhex(F.lit("84")), number(F.octet_length(b), 3), b))
