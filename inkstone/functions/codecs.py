"""Label codecs as column expressions: encoding, decoding, vocabulary filters, key formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(text: Column) -> Column:
    """The code points of a text (none of an empty one)."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def vocabulary(alphabet: str) -> Column:
    return F.array(*(F.lit(c) for c in alphabet))


def unknown(alphabet: str) -> str:
    """A pattern of one character that is not in ``alphabet``."""
    return f"[^{''.join(f'\\x{{{ord(c):x}}}' for c in alphabet)}]" if alphabet else "(?s)."


def ids(text: Column, alphabet: str, first: int = 1) -> Column:
    """Ids from ``first`` by place in ``alphabet``; an unknown character gives ``first`` - 1."""
    return F.transform(chars(text), lambda c: F.instr(F.lit(alphabet), c) + F.lit(first - 1))


def padded(values: Column, length: int) -> Column:
    """``values`` cut or filled with 0 to ``length``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0), length)), 1, length)


def ctc_encode(text: Column, alphabet: str, length: int) -> Column:
    """Ids from 1, padded with the blank 0."""
    return padded(ids(text, alphabet), length)


def strict(text: Column, alphabet: str, length: int) -> Column:
    """``text`` if it can be encoded; else the query fails, on a character that is not in ``alphabet`` or on more than ``length``."""
    bad = F.when(F.char_length(text) > length, F.concat(F.lit("label is longer than "), F.lit(str(length)), F.lit(": "), text)).when(~known(text, alphabet), F.concat(F.lit("label has characters outside the vocabulary: "), text))
    return F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(text)


def flat_ids(text: Column, alphabet: str) -> Column:
    """Ids from 1 without padding, as a row of the flat encoding has them."""
    return ids(text, alphabet)


def flat_decode(all_ids: Column, offset: Column, length: Column, alphabet: str) -> Column:
    """The text of one row of a flat id vector: blanks and adjacent repeats drop out within the row."""
    return ctc_decode(F.slice(all_ids, offset + 1, length), alphabet)


def attention_decode(values: Column, alphabet: str) -> Column:
    """All tokens of a row joined, markers too: 0 is ``[GO]``, 1 is ``[s]``, characters follow."""
    tokens = F.array(F.lit("[GO]"), F.lit("[s]"), *(F.lit(c) for c in alphabet))
    return F.array_join(F.transform(values, lambda x: F.element_at(tokens, x + 1)), "")


def prune_values(values: Column, text: Column, end: str = "[s]") -> Column:
    """The values (one a character) of what ``prune`` leaves of ``text``."""
    return F.slice(values, 1, F.greatest(F.lit(0), F.least(F.size(values), F.when(F.instr(text, end) > 0, F.instr(text, end) - 1).otherwise(F.char_length(text) - 1))))


def ctc_decode(values: Column, alphabet: str) -> Column:
    """Drop blanks and adjacent repeats (the first of a run stays) and look the rest up."""
    kept = F.filter(values, lambda x, i: (x != 0) & ((i == 0) | (F.get(values, i - 1) != x)))
    return F.array_join(F.transform(kept, lambda x: F.element_at(vocabulary(alphabet), x)), "")


def last_of_runs(values: Column) -> Column:
    """Positions (from 0) of values that are no blank and differ from the next one."""
    n = F.array_size(values)
    places = F.transform(values, lambda x, i: F.when((x != 0) & ((i == n - 1) | (F.get(values, i + 1) != x)), i))
    return F.filter(places, lambda i: i.isNotNull())


def attention_encode(text: Column, alphabet: str, length: int) -> Column:
    """Start token 0, ids from 2, end token 1, padded with 0 to ``length`` + 2; all 0 if a character is unknown."""
    found = ids(text, alphabet, first=2)
    row = F.concat(F.array(F.lit(0)), found, F.array(F.lit(1)))
    return padded(F.when(F.exists(found, lambda x: x == 1), F.array(F.lit(0))).otherwise(row), length + 2)


def prune(text: Column, end: str = "[s]") -> Column:
    """Up to the end token; without one the last character goes."""
    at = F.instr(text, end)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.substring(text, F.lit(1), F.char_length(text) - 1))


def known(text: Column, alphabet: str) -> Column:
    """Whether all characters are in ``alphabet``."""
    return ~text.rlike(unknown(alphabet))


def strip_unknown(text: Column, alphabet: str) -> Column:
    return F.regexp_replace(text, unknown(alphabet), "")


def record_key(kind: str, index: Column) -> Column:
    """Keys of the key-value view, as ``label-000000001``."""
    return F.format_string(f"{kind}-%09d", index)


def run_stamp(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """A UTC timestamp as a run's name in a fixed zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd_HH-mm-ss")
