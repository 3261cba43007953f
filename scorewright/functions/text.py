"""Column helpers that give Python string semantics with JVM-side expressions.

Java's ``\\s`` and Spark's ``trim`` are ASCII-only, Python's ``str.strip`` and
``re`` ``\\s`` are Unicode. ``(?U)`` plus the four separator controls
U+001C..U+001F reproduces Python's whitespace set. Everything here is a plain
``Column`` expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

PY_WS = "[\\s\\x1c-\\x1f]"
_STRIP_RE = f"(?U)^{PY_WS}+|{PY_WS}+\\z"
_COLLAPSE_RE = f"(?U){PY_WS}+"
# A float literal as Python's float() accepts it (underscore forms excluded).
_FLOAT_RE = "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$|(?i)^[+-]?(inf|infinity|nan)$"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """``str.strip()`` with Python's Unicode whitespace set."""
    return F.regexp_replace(c(x), _STRIP_RE, "")


def strip_chars(x, chars: str) -> Column:
    """``str.strip(chars)`` for a small literal character set."""
    cls = "".join("\\n" if ch == "\n" else "\\" + ch if not ch.isalnum() else ch for ch in chars)
    return F.regexp_replace(c(x), f"^[{cls}]+|[{cls}]+\\z", "")


def collapse_ws(x) -> Column:
    """``re.sub(r"\\s+", " ", s)`` with Python's Unicode whitespace."""
    return F.regexp_replace(c(x), _COLLAPSE_RE, " ")


def py_float(x) -> Column:
    """``float(s)`` or null where Python would raise. Spark's own cast accepts
    ``'1d'`` and ``'5f'``, so the literal is checked first."""
    return bare_float(py_strip(x))


def bare_float(s: Column) -> Column:
    """``py_float`` of a text that is already stripped."""
    return F.when(s.rlike(_FLOAT_RE), s.try_cast("double"))


def count_occurrences(x, needle: str) -> Column:
    """``str.count(needle)`` (non-overlapping)."""
    col = c(x)
    n = len(needle)
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))) / F.lit(n)).cast("int")


def regex_group_or_null(x, pattern: str, group: int = 1) -> Column:
    """First match's group, or null when the pattern does not occur at all
    (``regexp_extract`` alone returns '' for both cases)."""
    col = c(x)
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def truncate_preview(x, n: int, always: bool = False) -> Column:
    """First ``n`` characters + '...' (only when longer, unless ``always``)."""
    col = c(x)
    cut = F.concat(F.substring(col, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(col) > n, cut).otherwise(col)


def _accent_table() -> tuple[str, str]:
    """Diacritic folding table built by rule: every Latin letter in
    U+00C0..U+024F whose canonical decomposition is one base letter plus
    combining marks, and every one in U+1E00..U+1EFF with exactly one mark,
    maps to its base letter."""
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        parts = unicodedata.normalize("NFD", ch)
        base = "".join(b for b in parts if not unicodedata.combining(b))
        if base != ch and len(base) == 1 and (cp < 0x0250 or len(parts) == 2):
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_FROM, ACCENT_TO = _accent_table()


def fold_accents(x) -> Column:
    """Accented Latin letters as their base letter; separate accents dropped."""
    return F.regexp_replace(F.translate(c(x), ACCENT_FROM, ACCENT_TO), "\\p{Mn}+", "")


TOKEN_RE = "[\\p{L}\\p{N}]+"
#: The same tokens in a text as written, where separate accents still stand.
TOKEN_SPAN = "[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{Mn}]*"


def fts_tokens(x) -> Column:
    """Full-text tokens: case-folded, diacritics removed, runs of letters and
    digits."""
    return F.regexp_extract_all(fold_accents(F.lower(c(x))), F.lit(TOKEN_RE), 0)


def count_ws_tokens(x) -> Column:
    """Default token counter: whitespace-separated pieces."""
    return F.size(F.regexp_extract_all(c(x), F.lit("\\S+"), 0))
