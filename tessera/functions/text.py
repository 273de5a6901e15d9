"""Text functions as column expressions; all run in the JVM.

Unicode normalisation and full case folding are static methods of the ICU library that
Spark ships with, reached through the SQL function ``reflect``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, spelt out because engines differ in what \s covers.
WS = r"[ \t\n\x0B\f\r]+"


def _icu(cls: str, method: str, text: Column, flag: bool) -> Column:
    done = F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(flag))
    return F.when(text.isNotNull(), done)


def nfc(text: Column) -> Column:
    return _icu("text.Normalizer", "compose", text, False)


def nfkc(text: Column) -> Column:
    return _icu("text.Normalizer", "compose", text, True)


def casefold(text: Column) -> Column:
    return _icu("lang.UCharacter", "foldCase", text, True)


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, WS, " "))


def squeeze_all(text: Column) -> Column:
    """``squeeze`` with Unicode's white space and the separators of ASCII."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))


def lines(text: Column) -> Column:
    """The lines of a text at every end of line that Unicode names, form feeds and ASCII separators too."""
    return F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]")


def nfkc_clean(text: Column) -> Column:
    """NFKC without zero-width spaces and soft hyphens, white space squeezed, no space inside square brackets."""
    spaced = squeeze_all(F.translate(nfkc(text), "\u200b\u00ad", ""))
    return F.replace(F.replace(spaced, F.lit("[ "), F.lit("[")), F.lit(" ]"), F.lit("]"))


def nfc_squeeze(text: Column) -> Column:
    """NFC with white space squeezed; case and punctuation stay."""
    return squeeze_all(nfc(text))


def preview(text: Column, n: int) -> Column:
    return F.substring(squeeze(text), 1, n)


def whitespace_tokens(text: Column) -> Column:
    """Tokens between white space; an empty text has none."""
    t = squeeze(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def search_tokens(text: Column) -> Column:
    """Tokens for lexical search: compatibility form, case folded, runs of letters and digits."""
    return F.regexp_extract_all(casefold(nfkc(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical_json(columns: list[str]) -> Column:
    """Columns as one JSON object with sorted keys and no spaces; nulls are written."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def chunk_id(doc_id: Column, strategy: str, ordinal: Column, digest: Column) -> Column:
    return F.format_string(f"%s__{strategy}__%06d__%s", doc_id.cast("string"), ordinal.cast("int"), digest)


def section_chunk_id(doc_id: Column, strategy: str, section: Column, part: Column, digest: Column) -> Column:
    return F.format_string(f"%s__{strategy}__s%04d__c%04d__%s", doc_id.cast("string"), section.cast("int"), part.cast("int"), digest)


def visible_markdown(text: Column) -> Column:
    """What a reader sees: links as labels, tags as spaces, entities resolved, emphasis signs gone."""
    t = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return squeeze(F.regexp_replace(t, r"`|\*\*|__", ""))


def repair_extraction(text: Column) -> Column:
    """Mend words that PDF extraction splits, in compatibility form."""
    t = F.regexp_replace(nfkc(text), r"(?iU)Noti\s*\n\s*ce", "Notice")
    return squeeze_all(F.regexp_replace(t, r"(?iU)A\s+mount", "Amount"))


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def contains_literally(text: Column, quote: Column, min_chars: int = 20, min_words: int = 4) -> Column:
    """Whether a quote of enough length stands in a text, white space aside."""
    q = squeeze(quote)
    return F.contains(squeeze(text), q) & (F.length(q) >= min_chars) & (F.size(F.split(q, " ")) >= min_words)


def utc_timestamp(at: Column | None = None) -> Column:
    """A point in time (by default now) as ISO 8601 in UTC with a Z, whatever the session's time zone; whole seconds."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
