"""Deterministic ids. ``format_string`` widens past the padding, ``lpad`` would cut."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def segment_id(conv_id: Column, index: Column) -> Column:
    return F.format_string("%s_s%03d", conv_id, index)


def summary_id(segment: Column) -> Column:
    return F.concat(segment, F.lit("_ss"))


def extract_id(segment: Column) -> Column:
    return F.concat(segment, F.lit("_x"))


def statement_id(extract: Column, index: Column) -> Column:
    return F.format_string("%s_st%04d", extract, index)


def fragment_id(extract: Column, index: Column) -> Column:
    return F.format_string("%s_f%03d", extract, index)


def topic_id(conv_id: Column, index: Column) -> Column:
    return F.format_string("%s_t%03d", conv_id, index)


def message_key(raw_id: Column, conv_id: Column, role: Column, text: Column, when_text: Column) -> Column:
    """The stripped raw id, else 16 hex digits of a hash over the message."""
    from colloquy.functions.text import null_if_empty, strip

    payload = F.concat_ws("|", conv_id, role, text, F.coalesce(when_text, F.lit("")))
    hashed = F.concat(F.lit("hash_"), F.substring(F.sha2(payload, 256), 1, 16))
    return F.coalesce(null_if_empty(strip(raw_id)), hashed)
