"""Transcript and path expressions; all are plain Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavelot.schemas import EMPTY_TEXT

# The character ranges that count as CJK.
CJK = r"\u1100-\u11ff\u2e80-\ua4cf\ua840-\ud7af\uf900-\ufaff\ufe30-\ufe4f\uff65-\uffdc\x{20000}-\x{2ffff}"
_GAP = r"[\s\u3000]"


def join_cjk(text: Column) -> Column:
    """Drop white space between adjacent CJK characters, ideographic spaces everywhere; trim."""
    plain = F.regexp_replace(text, r"\u3000", "")
    return F.regexp_replace(F.regexp_replace(plain, rf"(?<=[{CJK}])\s+(?=[{CJK}])", ""), r"^\s+|\s+$", "")


def split_cjk(text: Column) -> Column:
    """Single spaces around each CJK character; other words keep their inner spaces."""
    wide = F.regexp_replace(text, rf"{_GAP}*([{CJK}]){_GAP}*", " $1 ")
    return F.regexp_replace(F.regexp_replace(wide, rf"(?<=[{CJK}])  (?=[{CJK}])", " "), rf"^{_GAP}+|{_GAP}+$", "")


def normal_text(text: Column) -> Column:
    """CJK text without spaces, other text as it is, one space where the two meet."""
    return join_cjk(split_cjk(text))


def text_or_empty(text: Column) -> Column:
    """The marker for a missing or blank transcript, else the transcript as it is."""
    return F.when(text.isNull() | ~text.rlike(r"(?U)\S"), F.lit(EMPTY_TEXT)).otherwise(text)


def sample_key(file_name: Column) -> Column:
    """A file's name without its last extension, so that dotted names stay whole."""
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def sample_ext(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"\.([^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def shard_key(path: Column) -> Column:
    """A tar's base name without .tar or .tar.gz, else without its last extension."""
    name = base_name(path)
    return F.when(name.rlike(r"\.tar(\.gz)?$"), F.regexp_replace(name, r"\.tar(\.gz)?$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def map_prefix(key: Column, audio_prefix: str | None, text_prefix: str | None) -> Column:
    """Swap audio_prefix for text_prefix; null where the key lacks it. Give both or neither."""
    if (audio_prefix is None) != (text_prefix is None):
        raise ValueError("give both prefixes or neither")
    if audio_prefix is None:
        return key
    return F.when(key.startswith(audio_prefix), F.concat(F.lit(text_prefix), F.substring(key, len(audio_prefix) + 1, 1 << 30)))


def shard_name(prefix: str, index: Column, bits: int = 8) -> Column:
    return F.format_string(f"{prefix.replace('%', '%%')}.%0{bits}d", index)
