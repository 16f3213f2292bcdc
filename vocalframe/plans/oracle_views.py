"""DuckDB SQL building blocks for the oracle side of every registered query.

They restate the fixture views of :mod:`vocalframe.sources.fixtures` in plain SQL
over the pre-registered Parquet views. They are written independently of the
Spark code (different engine, different functions) so that agreement means
something. DuckDB has no NFKC; the test corpus contains no character NFKC
changes, which the unit tests pin separately.
"""

from __future__ import annotations

from vocalframe.functions.text import BRACKET_SPAN, MARK_SYMBOL_PUNCT, PAREN_SPAN, WHITESPACE_RUN

# RE2 spelling of the Unicode category class
_MSP = MARK_SYMBOL_PUNCT.replace(r"\p{M}", r"\pM").replace(r"\p{S}", r"\pS").replace(r"\p{P}", r"\pP")


def t1(x: str) -> str:
    s = f"lower({x})"
    s = f"regexp_replace({s}, '{BRACKET_SPAN}', '', 'g')"
    s = f"regexp_replace({s}, '{PAREN_SPAN}', '', 'g')"
    s = f"regexp_replace({s}, '{_MSP}', ' ', 'g')"
    return f"regexp_replace(lower({s}), '{WHITESPACE_RUN}', ' ', 'g')"


def light(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{WHITESPACE_RUN}', ' ', 'g'))"


def split_words(x: str) -> str:
    """Tokens of an already-normalised string (single spaces only)."""
    return f"CASE WHEN trim({x}) = '' THEN []::VARCHAR[] ELSE string_split(trim({x}), ' ') END"


def chars(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, '') END"


def encoded(x: str, dictionary: str) -> str:
    """Map each character to one ASCII character via its dictionary position, so
    DuckDB's byte-based levenshtein counts characters."""
    return (f"array_to_string(list_transform({chars(x)}, lambda c: "
            f"chr(32 + list_position({dictionary}, c))), '')")


LINES = """lines AS (
  SELECT doc_id * 4294967296 + pos AS idx, doc_id, pos, source AS speaker, lang, line AS text
  FROM (SELECT doc_id, source, lang,
               unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS pos
        FROM documents)
  WHERE trim(line) <> '')"""

UTT = f"""utt AS (SELECT *, {t1('text')} AS norm FROM lines)"""

TOK = f"""tok AS (SELECT *, {split_words('norm')} AS w FROM utt)"""

HYP = """hyp AS (
  SELECT *, list_transform(list_filter(w, lambda x, i: i % 7 <> 0),
                           lambda x, k: CASE WHEN k % 5 = 0 THEN 'zz' ELSE x END) AS hw
  FROM tok)"""

# Word errors: the hypothesis deletes floor(n/7) words and substitutes
# floor((n - floor(n/7))/5) by a token absent from the reference. Any alignment
# must pay the length difference plus one per such token, so the Levenshtein
# distance equals exactly that count: an independent oracle for A1.
ERR = f"""err AS (
  SELECT idx, doc_id, speaker, lang, rs, hs,
         (len(w) // 7 + (len(w) - len(w) // 7) // 5)::BIGINT AS word_errors,
         len(w)::BIGINT AS ref_words,
         levenshtein({encoded('rs', 'd')}, {encoded('hs', 'd')})::BIGINT AS char_errors,
         length(rs)::BIGINT AS ref_chars
  FROM (SELECT *, list_distinct({chars('rs')} || {chars('hs')}) AS d
        FROM (SELECT *, array_to_string(w, ' ') AS rs, array_to_string(hw, ' ') AS hs FROM hyp)))"""

SEV = """sev AS (
  SELECT source AS speaker,
         (['Normal','Mild','Moderate','Mod-Sev','Severe','Unlisted'])[
            (regexp_extract(source, '(\\d+)$', 1)::INTEGER % 6) + 1] AS severity
  FROM (SELECT DISTINCT source FROM documents)),
sevd AS (
  SELECT speaker, severity,
         nullif(list_position(['Normal','Mild','Moderate','Mod-Sev','Severe'], severity), 0)::INTEGER AS sev_pos
  FROM sev)"""

SCORED = ",\n".join([LINES, UTT, TOK, HYP, ERR])


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def rates(prefix: str = "") -> str:
    return (f"CASE WHEN sum(ref_words) > 0 THEN 100.0::DOUBLE * sum(word_errors) / sum(ref_words) END AS {prefix}wer, "
            f"CASE WHEN sum(ref_chars) > 0 THEN 100.0::DOUBLE * sum(char_errors) / sum(ref_chars) END AS {prefix}cer, "
            "count(*)::BIGINT AS num_samples, sum(word_errors)::BIGINT AS word_errors, "
            "sum(ref_words)::BIGINT AS ref_words, sum(char_errors)::BIGINT AS char_errors, "
            "sum(ref_chars)::BIGINT AS ref_chars")
