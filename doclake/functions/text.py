"""Text columns: trimming, paragraph and sentence splitting, token counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from doclake.schemas import SPECIAL_TOKENS

# Every code point Unicode calls white space, and the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS_CLASS = f"[{_SPACES}]"

# Line ends (a pair of CR and LF counts once).
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"

# A token is a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _SPACES + "]"

PARAGRAPH_BREAK = r"\n{2,}"
SENTENCE_BREAK = r"(?<=[.!?])" + WS_CLASS + "+"


def strip(text: Column) -> Column:
    """Trim Unicode white space from both ends (``trim`` alone removes only U+0020)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda piece: piece != "")


def paragraphs(text: Column) -> Column:
    """Non-blank, trimmed pieces between runs of two or more newlines."""
    return _pieces(text, PARAGRAPH_BREAK)


def sentences(text: Column) -> Column:
    """Trimmed sentences of all paragraphs: a break is white space after ``.``, ``!`` or ``?``."""
    return F.flatten(F.transform(paragraphs(text), lambda p: _pieces(p, SENTENCE_BREAK)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def raw_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def token_count(text: Column) -> Column:
    """Tokens of ``text`` with the two special tokens an encoder adds."""
    return raw_token_count(text) + F.lit(SPECIAL_TOKENS)


def last_tokens(text: Column, n: int) -> Column:
    """The suffix of ``text`` that starts at its n-th last token; all of it if it has no more than n."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?:{TOKEN}){WS_CLASS}*"), F.lit(0))
    return F.array_join(F.slice(pieces, -F.greatest(F.lit(1), F.least(F.lit(n), F.size(pieces))), F.lit(n)), "")


def approx_tokens(text: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def prefixed(text: Column, kind: str) -> Column:
    """``query: `` or ``passage: `` before the trimmed text, as asymmetric encoders expect."""
    if kind not in ("query", "passage"):
        raise ValueError(f"kind must be 'query' or 'passage', not {kind!r}")
    return F.concat(F.lit(f"{kind}: "), strip(text))
