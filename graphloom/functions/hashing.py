"""Uniform and normal numbers as functions of keys, the same in Spark, in DuckDB and on every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the parts joined by ':'; strings name columns' values, use ``F.lit`` for texts."""
    joined = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number, by the polar form of two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("a")) + 2.0**-33)) * F.cos(F.lit(6.283185307179586) * uniform(*parts, F.lit("b")))


def sql_uniform(*parts: str) -> str:
    """The same as an SQL expression for DuckDB."""
    joined = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_TENS = 10 ** np.arange(1, 19, dtype=np.int64)
_TURNS = [(np.array(t, np.uint32), np.array(32 - t, np.uint32)) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in 4 * four]  # arrays spare numpy the look at a number
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.int64).tolist()
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The four digits of each number up to 9999, as the bytes of a word.
_DIGITS = sum((np.arange(10_000) // 10 ** (3 - i) % 10 + 48) << 8 * i for i in range(4)).astype(np.uint32)


def _first_word(fixed: list[int], varied: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first 4 bytes, as one number, of the MD5 of ``n`` messages of one padded block, of which the 16 words ``fixed`` are the
    same for all and ``varied`` are added to some. The steps run in place, and those that the first word doesn't need are left out."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f = np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, np.array((_SINES[i] + fixed[k]) % 2**32, np.uint32), out=a)
        if k in varied:
            np.add(a, varied[k], out=a)
        left, right = _TURNS[i]
        np.left_shift(a, left, out=f)
        np.right_shift(a, right, out=a)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    b += np.uint32(_START[0])
    return b.byteswap()


def _digits_into(varied: dict[int, np.ndarray], own: np.ndarray, digits: int, end: int) -> None:
    """Adds the decimal ``digits`` of numbers, which end before byte ``end`` of their messages, to the messages' words."""
    own = own.astype(np.uint32) if digits < 10 else own
    while digits > 0:
        taken = min(4, digits)
        rest = own // 10_000 if digits > 4 else 0
        word = _DIGITS[own - rest * 10_000] >> np.uint32(32 - 8 * taken)
        end, digits, own = end - taken, digits - taken, rest
        k, shift = divmod(end, 4)
        for at, part in ((k, word << np.uint32(8 * shift)), (k + 1, word >> np.uint32(32 - 8 * shift) if shift + taken > 4 else None)):
            if part is not None:
                varied[at] = varied[at] + part if at in varied else part


def uniform_array(*parts: np.ndarray | str | int, block: int = 1 << 15) -> np.ndarray:
    """``uniform`` inside a task: the parts are texts and numbers for all, or arrays of whole numbers."""
    given = [p.astype(np.int64, copy=False) if isinstance(p, np.ndarray) else str(p).encode() for p in parts]
    n = len(next(p for p in given if isinstance(p, np.ndarray)))
    out = np.empty(n)
    kinds: np.ndarray | int = 0  # messages of one form: the signs and numbers of digits of their parts
    for p in given if n else []:
        if isinstance(p, np.ndarray):
            low, high = int(p.min()), int(p.max())
            one = low >= 0 and len(str(low)) == len(str(high))
            kinds = kinds * 40 + (2 * (len(str(low)) - 1) if one else (2 * np.searchsorted(_TENS, np.abs(p), side="right") + (p < 0)))
    for kind in ([kinds] if n else []) if isinstance(kinds, int) else np.unique(kinds).tolist():
        chosen = slice(0, n) if isinstance(kinds, int) else np.flatnonzero(kinds == kind)
        made = [p[chosen] if isinstance(p, np.ndarray) else p for p in given]
        forms, left = [], kind
        for p in made[::-1]:
            forms.append(left % 40 if isinstance(p, np.ndarray) else None)
            left = left // 40 if isinstance(p, np.ndarray) else left
        text, ends = bytearray(), []
        for j, (p, form) in enumerate(zip(made, forms[::-1], strict=True)):
            text += b":" if j else b""
            text += p if form is None else b"-" * (form % 2) + bytes(form // 2 + 1)
            ends.append((form, len(text)))
        if len(text) > 55:
            raise ValueError("the parts are too long")
        whole = bytes(text) + b"\x80" + bytes(55 - len(text)) + (8 * len(text)).to_bytes(8, "little")
        fixed = np.frombuffer(whole, "<u4").tolist()
        size = n if isinstance(kinds, int) else len(chosen)
        found = np.empty(size)
        for at in range(0, size, block):
            varied: dict[int, np.ndarray] = {}
            for p, (form, end) in zip(made, ends, strict=True):
                if form is not None:
                    _digits_into(varied, np.abs(p[at : at + block]), form // 2 + 1, end)
            np.divide(_first_word(fixed, varied, min(block, size - at)), 4294967296.0, out=found[at : at + block])
        out[chosen] = found
    return out
