"""Fill-in-middle: texts cut at word boundaries that are found in whole-text bit masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm._text import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_NAMES = ("n_tokens", "form", "prefix_chars", "middle_chars", "fim_text")


def _class_table(members) -> bytes:
    """For bytes.translate: digit 1 for the members, digit 0 for all else."""
    return bytes(0x31 if b in members else 0x30 for b in range(256))


_BLANK = _class_table({0x20, *range(0x09, 0x0E)})
#: Bytes that begin a code point.
_LEADING = _class_table(set(range(256)) - set(range(0x80, 0xC0)))


def class_mask(text: bytes, table: bytes) -> int:
    """Bit i is set if byte i belongs to the class."""
    return int(text[::-1].translate(table), 2) if text else 0


def token_ends(text: bytes) -> int:
    """Bit i is set if a token ends with byte i: blanks before a word belong to it, blanks after the last word are one."""
    if not text:
        return 0
    top = 1 << len(text) - 1
    blank = class_mask(text, _BLANK)
    word = blank ^ ((top << 1) - 1)
    return word & (blank >> 1 | top) | blank & top


def nth_bit(mask: int, length: int, rank: int) -> int:
    """Position of the set bit of a rank, from 1, in a mask of so many bits: the half that holds it is halved again."""
    at = 0
    while length > 1:
        half = length >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank <= below:
            mask, length = low, half
        else:
            mask, at, rank, length = mask >> half, at + half, rank - below, length - half
    return at


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the sha256 of seed:key; the key of a null is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: bytes, key: object, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix and of the middle, output) of one text."""
    ends = token_ends(text)
    n = ends.bit_count()
    a, b, chosen, kind = draws(seed, key)
    if not text or any(m in text for m in _MARKS) or chosen % 100 >= percent:
        return n, "plain", None, None, text
    first, last = (nth_bit(ends, len(text), k) + 1 if k else 0 for k in sorted((a % (n + 1), b % (n + 1))))
    leading = class_mask(text, _LEADING)
    until = lambda at: (leading & ((1 << at) - 1)).bit_count()
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = _MARKS
    if kind % 100 < spm_percent:
        form, out = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, out = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return n, form, until(first), until(last) - until(first), out


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", column: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """The documents with n_tokens, form, prefix_chars, middle_chars and fim_text.

    A token is a word with the blanks before it; blanks at the end of a text are a token of their own.
    Numbers drawn from the sha256 of ``seed``:id choose two cuts between tokens and, with ``percent``, whether
    a text is rearranged at all: psm puts the middle last, spm (``spm_percent`` of those) the suffix first.
    Empty texts and texts that hold one of the marks stay plain; their prefix_chars and middle_chars are
    null. A null text is empty and a null id draws as an empty one; rows that share an id draw alike, each
    from its own text. An empty table gives no rows. Other columns pass through, whatever their names,
    except that columns named like the five new ones are replaced.

    A text of any length is worked on whole, as integers of one bit for each byte: masks by bytes.translate,
    ends of tokens by shifts, their number by bit_count, and the ends drawn by halving. Each row is
    worked on where it is read; nothing is shuffled.
    """
    docs = docs.drop(*[n for n in docs.columns if n.lower() in _NAMES])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_tokens long", "form string", "prefix_chars long", "middle_chars long", "fim_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            ids = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
            texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
            found = list(zip(*(transform(t.as_py() or b"", i, seed, percent, spm_percent) for i, t in zip(ids, texts, strict=True)), strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary())
            more = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            more[4] = more[4].cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *_NAMES])

    return docs.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    one, two = F.split(rest, SUFFIX, 2), F.split(rest, PREFIX, 2)
    ends = lambda x: F.split(x, MIDDLE, 2)
    psm = F.concat(one[0], ends(one[1])[1], ends(one[1])[0])
    spm = F.concat(ends(two[1])[0], ends(two[1])[1], two[0])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame, **options) -> DataFrame:
    out = fill_in_middle(docs.select("doc_id", "text"), **options)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("fim_text")).alias("output_sha256"), sha(restore(F.col("fim_text"), F.col("form"))).alias("restored_sha256"))
