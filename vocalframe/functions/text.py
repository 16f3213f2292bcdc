"""Text column expressions (T1-T3, T11, T12), built-in expressions only. NFKC,
which Spark SQL lacks, runs in the JVM through ICU4J (bundled with Spark) on just
the rows holding a character outside a known NFKC-stable set; an Arrow UDF is
the fallback where ICU4J is not on the classpath.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (same meaning as the public speech-normaliser description):
# spans to drop, the Unicode categories replaced by a space, and the characters
# Python's str.isspace() treats as whitespace (Java's (?U)\s lacks \x1c-\x1f).
BRACKET_SPAN = r"[<\[][^>\]]*[>\]]"
PAREN_SPAN = r"\([^)]+\)"
MARK_SYMBOL_PUNCT = r"[\p{M}\p{S}\p{P}]"
PY_WHITESPACE = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WHITESPACE_RUN = PY_WHITESPACE + "+"

# Characters whose NFKC form is themselves and that never combine with a
# neighbour: ASCII, Latin-1 letters, Latin Extended-A minus its five
# compatibility characters (U+0133, U+013F, U+0140, U+0149, U+017F).
NFKC_UNSAFE = r"[^\x{00}-\x{7f}\x{c0}-\x{132}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}]"


def _but(known: list[int], cls: str) -> str:
    """The class ``cls`` without the characters ``known`` (below 256): they are listed one by one, so
    a character is first looked up in a table, and most are told there."""
    return f"[[^{''.join(f'\\x{c:02x}' for c in known)}]&&{cls}]"


_UNSAFE_FAST = _but([*range(0x80), *range(0xc0, 0x100)], NFKC_UNSAFE)


@F.pandas_udf(T.StringType())
def _nfkc_arrow(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


_ICU_OK: dict[str, bool] = {}


def icu_available(spark) -> bool:
    """Whether ICU4J (shipped with Spark 4 for collations) is reachable from SQL;
    probed once per session with a one-row literal query."""
    key = spark.sparkContext.applicationId
    if key not in _ICU_OK:
        try:
            got = spark.sql("SELECT reflect('com.ibm.icu.text.Normalizer', 'compose', "
                            "'\\uFB01', true) AS v").collect()[0][0]
            _ICU_OK[key] = got == "fi"
        except Exception:  # noqa: BLE001 - not on the classpath
            _ICU_OK[key] = False
    return _ICU_OK[key]


def nfkc(c: Column, jvm: bool = True) -> Column:
    """NFKC. ``jvm``: ICU4J's compatibility composition through SQL ``reflect``
    (stays in the JVM); otherwise an Arrow UDF that sends only non-null values."""
    if jvm:
        return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"),
                               c, F.lit(True))
    return F.coalesce(_nfkc_arrow(c), c)


def needs_nfkc(c: Column) -> Column:
    """Rows holding a character outside the NFKC-stable set; the byte/char length
    test short-circuits the regex for ASCII-only text."""
    return (F.char_length(c) != F.octet_length(c)) & c.rlike(_UNSAFE_FAST)


def _pre(c: Column) -> Column:
    """Lowered, without spans; a text that opens none is not searched (no letter lowers to an opening sign)."""
    s = F.lower(c)
    opens = c.contains("<") | c.contains("[") | c.contains("(")
    return F.when(opens, F.regexp_replace(F.regexp_replace(s, BRACKET_SPAN, ""), PAREN_SPAN, "")).otherwise(s)


# One pass for "marks/symbols/punctuation -> space, then whitespace runs -> one
# space": both turn every maximal run of such characters into a single space. One
# character class, not an alternative of two: its runs need no stack.
MSP_OR_WS_RUN = MARK_SYMBOL_PUNCT[:-1] + PY_WHITESPACE[1:] + "+"
_KEPT = [c for c in range(256) if unicodedata.category(chr(c))[0] in "LN"]
_MSP_OR_WS = _but(_KEPT, MSP_OR_WS_RUN[:-1])
# a run that is one space stays as it is
_CHANGED_RUN = f"(?:{_but([0x20, *_KEPT], MSP_OR_WS_RUN[:-1])}| {_MSP_OR_WS}){_MSP_OR_WS}*+"


def _post(c: Column) -> Column:
    return F.regexp_replace(c, _CHANGED_RUN, " ")


def basic_normalize(c: Column) -> Column:
    """T1 without the NFKC step, as one expression (for inputs known to need none)."""
    return _post(_pre(c))


def with_normalized(df: DataFrame, src: str | dict[str, str], dst: str | None = None,
                    unicode_nfkc: bool = True) -> DataFrame:
    """T1 as a DataFrame step: lower, drop <..>/[..] and (..) spans, NFKC, marks/
    symbols/punctuation to space, lower again, collapse whitespace runs (no strip).

    Only rows with a character outside the NFKC-stable set take the NFKC step and
    the second lower (replacing symbols by spaces commutes with lowercasing, and
    both steps are the identity on the other rows). ``src`` may map several
    source columns to targets. The pre-NFKC text is bound once per row, so
    Catalyst cannot copy the regex chain into each of its uses.
    """
    from vocalframe.functions.bind import bind
    pairs = src if isinstance(src, dict) else {src: dst}
    tmp = {d: f"__{d}_pre" for d in pairs.values()}
    out = bind(df, {tmp[d]: _pre(F.col(s)) for s, d in pairs.items()})
    jvm = icu_available(df.sparkSession) if unicode_nfkc else True
    post = {}
    for d in pairs.values():
        t = F.col(tmp[d])
        if unicode_nfkc:
            if jvm:
                t = F.when(needs_nfkc(t), F.lower(nfkc(t, True))).otherwise(t)
            else:
                t = F.coalesce(F.lower(_nfkc_arrow(F.when(needs_nfkc(t), t))), t)
        post[d] = _post(t)
    return bind(out, post, drop=tuple(tmp.values()))


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, rf"^{WHITESPACE_RUN}|{WHITESPACE_RUN}$", "")


def light_normalize(c: Column) -> Column:
    """``' '.join(s.lower().split())`` with null read as ''."""
    return F.array_join(words(F.lower(c)), " ")


def words(c: Column) -> Column:
    """``s.split()``: whitespace tokens, empty list for blank or null input."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITESPACE_RUN), "")


def normalized_words(c: Column) -> Column:
    """Tokens of T1 output, whose only whitespace is single spaces."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), " "), "")


def word_count(c: Column) -> Column:
    """Number of whitespace tokens; 0 for empty/null."""
    return F.size(words(c))


def format_metric(c: Column, digits: int = 3) -> Column:
    """Fixed decimals, or an em dash for a missing value."""
    # round the exact value first: Java's %f alone rounds the shortest decimal
    # form of the double, which differs from Python's formatting at ties
    # a null formats as "nul" with a precision, so it is told apart first
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.round(c, digits))).otherwise("—")


def or_default(c: Column, default: str = "") -> Column:
    """``x or default`` for strings (null and '' both fall back)."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
