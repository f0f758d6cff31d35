"""Operator 11: fill-in-middle transformation by a table-driven byte DFA.

A text's units are its runs of ASCII letters and its other code points. One
automaton over bytes sees unit boundaries, UTF-8 continuation and the sentinels
at once: ``NEXT`` has the state after a byte of each class, ``EMIT`` what the
transition counts (a unit begins, a code point begins, a sentinel ends).

Texts are cut into blocks of ``BLOCK`` bytes, all blocks of a slice advance side
by side, one table look-up a byte. As a block's first state is not known yet,
each is run from every state; the blocks' state maps are then composed in a
doubling scan, which gives each its true first state and so its counts. With
the units counted and the cuts drawn, a second pass runs only the blocks that
hold a cut and stops at its byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.columns import named, numbered
from graphloom.llm.store import by_bytes
from graphloom.llm.subwords import forget_encoders, slices
from graphloom.llm.textkernel import utf8

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, TRANSFORMED_PERCENT, SPM_PERCENT = 1, 90, 20
#: Bytes of a block; counts within one fit 10 bits each.
BLOCK = 256

_LETTER, _KEY, _OPEN, _CLOSE, _OTHER, _MORE, _PAD = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_CLASS[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = _KEY
_CLASS[ord("<")], _CLASS[ord(">")] = _OPEN, _CLOSE
_CLASS[0x80:0xC0] = _MORE
#: States: between letters, in a run of letters, after "<", after "<" and a sentinel's letter.
_BETWEEN, _RUN, _OPENED, _KEYED = range(4)
NEXT = np.array([
    [_RUN, _RUN, _OPENED, _BETWEEN, _BETWEEN, _BETWEEN, _BETWEEN],
    [_RUN, _RUN, _OPENED, _BETWEEN, _BETWEEN, _BETWEEN, _RUN],
    [_RUN, _KEYED, _OPENED, _BETWEEN, _BETWEEN, _BETWEEN, _OPENED],
    [_RUN, _RUN, _OPENED, _BETWEEN, _BETWEEN, _BETWEEN, _KEYED],
], np.uint8)
_UNIT, _POINT, _SENTINEL = 1, 1 << 10, 1 << 20
EMIT = np.array([
    [_UNIT + _POINT, _UNIT + _POINT, _UNIT + _POINT, _UNIT + _POINT, _UNIT + _POINT, 0, 0],
    [_POINT, _POINT, _UNIT + _POINT, _UNIT + _POINT, _UNIT + _POINT, 0, 0],
    [_UNIT + _POINT, _UNIT + _POINT, _UNIT + _POINT, _UNIT + _POINT, _UNIT + _POINT, 0, 0],
    [_POINT, _POINT, _UNIT + _POINT, _UNIT + _POINT + _SENTINEL, _UNIT + _POINT, 0, 0],
], np.int32)


class Scan:
    """The first scan of many texts: for each, its units, code points and whether it holds a sentinel."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.size = np.diff(offsets)
        many = -(-self.size // BLOCK)
        self.first = np.cumsum(many) - many  # a text's first block
        text = np.repeat(np.arange(len(many)), many)
        inside = (np.arange(len(text)) - self.first[text]) * BLOCK  # where a block begins in its text
        self.begin = inside
        classes = np.full((len(text), BLOCK), _PAD, np.uint8)
        place = (self.first * BLOCK)[np.repeat(np.arange(len(many)), self.size)] + np.arange(len(raw)) - np.repeat(offsets[:-1], self.size)
        classes.reshape(-1)[place] = _CLASS[raw]
        self.classes = classes
        ends, counted = _run(classes)
        opens = np.zeros(len(text), bool)
        opens[self.first[many > 0]] = True
        self.state = _first_states(ends, opens)
        found = counted[self.state, np.arange(len(text))]
        self.units, self.points = found & 1023, found >> 10 & 1023
        self.units_upto, self.points_upto = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (self.units, self.points))
        last = self.first + many
        self.n = self.units_upto[last] - self.units_upto[self.first]
        self.length = self.points_upto[last] - self.points_upto[self.first]
        sentinels = np.concatenate([[0], np.cumsum(found >> 20)])
        self.marked = sentinels[last] > sentinels[self.first]

    def locate(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte and the code point of each text at which this unit (from 0) begins; the text's end for its n-th."""
        at, point = self.size[text].copy(), self.length[text].copy()
        inner = np.flatnonzero(unit < self.n[text])
        if len(inner):
            text = text[inner]
            wanted = self.units_upto[self.first[text]] + unit[inner]
            block = np.searchsorted(self.units_upto[1:], wanted, "right")
            step, before = _find(self.classes[block], self.state[block], wanted - self.units_upto[block] + 1)
            at[inner] = self.begin[block] + step
            point[inner] = self.points_upto[block] - self.points_upto[self.first[text]] + before
        return at, point


def _run(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last state and the counts of each block, from each state (states x blocks)."""
    state = np.repeat(np.arange(len(NEXT), dtype=np.uint8)[:, None], len(classes), axis=1)
    counted = np.zeros(state.shape, np.int32)
    width, after, emitted = np.uint8(NEXT.shape[1]), NEXT.reshape(-1), EMIT.reshape(-1)
    for step in np.ascontiguousarray(classes.T):
        move = state * width + step
        counted += emitted[move]
        state = after[move]
    return state, counted


def _first_states(ends: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The true first state of each block; ``opens`` marks the first blocks of texts, which begin between letters."""
    upto = np.where(opens, ends[_BETWEEN], ends)  # what stands before a text has no effect on it
    step = 1
    while step < upto.shape[1]:
        upto[:, step:] = np.take_along_axis(upto[:, step:], upto[:, :-step].astype(np.int64), 0)
        step *= 2
    out = np.full(len(opens), _BETWEEN, np.int64)
    out[1:] = np.where(opens[1:], _BETWEEN, upto[_BETWEEN, :-1])
    return out


def _find(classes: np.ndarray, state: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte of each block at which its ``nth`` unit (from 1) begins, and the code points before it."""
    seen, points = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
    at, before = np.full(len(classes), -1), np.zeros(len(classes), np.int64)
    for i, step in enumerate(np.ascontiguousarray(classes.T)):
        emitted = EMIT[state, step]
        seen += emitted & 1
        here = (at < 0) & (seen == nth)
        at[here], before[here] = i, points[here]
        points += emitted >> 10 & 1
        state = NEXT[state, step]
    return at, before


def transform(texts: pa.Array, draws: np.ndarray, transformed: int = TRANSFORMED_PERCENT, spm: int = SPM_PERCENT) -> dict[str, pa.Array]:
    """Output, n, form, prefix_chars and middle_chars of each text; ``draws`` are four unsigned numbers for each."""
    raw, offsets = utf8(texts)
    scan = Scan(raw, offsets)
    many = scan.n + 1
    drawn = np.sort(draws[:, :2] % many[:, None], axis=1)
    plain = (scan.n == 0) | scan.marked | (draws[:, 2] % 100 >= transformed)
    suffix_first = draws[:, 3] % 100 < spm
    cut = np.flatnonzero(~plain)
    (at, a), (to, b) = (scan.locate(cut, drawn[cut, i]) for i in (0, 1))
    data, ends = raw.tobytes(), offsets.tolist()
    out = [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for row, i, j, swap in zip(cut.tolist(), at.tolist(), to.tolist(), suffix_first[cut].tolist(), strict=True):
        whole = out[row]
        out[row] = s + whole[j:] + p + whole[:i] + m + whole[i:j] if swap else p + whole[:i] + s + whole[j:] + m + whole[i:j]
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    spans = [np.zeros(len(plain), np.int64) for _ in range(2)]
    spans[0][cut], spans[1][cut] = a, b - a
    return {"text": pa.array(out, pa.binary()).cast(pa.string()), "n": pa.array(scan.n, pa.int64()), "form": pa.array(form.tolist(), pa.string()), **{name: pa.array(x, pa.int64(), mask=plain) for name, x in zip(("prefix_chars", "middle_chars"), spans, strict=True)}}


def _draws(seed: int, id_col: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_col: str = "fim", seed: int = SEED, transformed: int = TRANSFORMED_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """``documents`` with each text rearranged, and ``fim_col``: struct of n, form, prefix_chars and middle_chars.

    Cuts and form depend on the seed and the id only: rows that share an id draw alike, a null id draws as the empty
    word. ``transformed`` per cent of the texts are rearranged, ``spm`` per cent of these with the suffix first. A null
    or empty text, or one that holds a sentinel, stays as it is (null: empty); its spans are null, as those of all plain
    texts. Other columns are kept, whatever their names; one named as ``fim_col``, in any case, is replaced. Texts are taken
    whole, at any length. An empty table gives no rows.
    """
    kept = documents.select(*[named(c) for c in documents.columns if c.lower() != fim_col.lower()])
    at = kept.columns.index(text_col)
    drawn = numbered(kept.select("*", _draws(seed, id_col)))
    fields = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])
    schema = T.StructType([*kept.schema.fields, T.StructField(fim_col, fields)])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for i, j in slices(batch.column(at), 2 << 20):
                part = batch.slice(i, j - i)
                draws = part.column(part.num_columns - 1).flatten().to_numpy().reshape(-1, 4)
                found = transform(part.column(at), draws, transformed, spm)
                fim = pa.StructArray.from_arrays([found[f] for f in fields.names], fields.names)
                columns = [found["text"] if k == at else part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, fim], schema.names)

    return by_bytes(drawn).mapInArrow(move, schema)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from output and form alone: each sentinel occurs once in an output that is not plain."""
    body = F.substring(output, 4, 1 << 30)

    def rebuilt(second: str, prefix_last: bool) -> Column:
        one, middle = F.substring_index(body, second, 1), F.substring_index(body, MIDDLE, -1)
        two = F.substring_index(F.substring_index(body, MIDDLE, 1), second, -1)
        return F.concat(two, middle, one) if prefix_last else F.concat(one, middle, two)

    return F.when(form == "psm", rebuilt(SUFFIX, False)).when(form == "spm", rebuilt(PREFIX, True)).otherwise(output)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents
), h AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
         ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1 : b], ''), '') AS middle,
         coalesce(array_to_string(u[b + 1 :], ''), '') AS suffix
  FROM c
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM p
), w AS (
  SELECT *, strpos(output, '<P>') AS ip, strpos(output, '<S>') AS i_s, strpos(output, '<M>') AS im FROM o
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
         WHEN 'psm' THEN substr(output, 4, i_s - 4) || substr(output, im + 3) || substr(output, i_s + 3, im - i_s - 3)
         ELSE substr(output, ip + 3, im - ip - 3) || substr(output, im + 3) || substr(output, 4, ip - 4) END) AS restored_sha256
FROM w
"""
