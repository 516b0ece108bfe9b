"""Text-cleaning expressions: every function maps ``Column -> Column``.

All of them compile to JVM string functions inside one whole-stage-codegen Project;
no Python runs per row.  Semantics follow the 2020 pandas behaviour of
``Series.str.replace(pat, repl)``: a pattern longer than one character is a regular
expression, a single character is taken literally, rules apply one after the other.
Phrases without regex metacharacters are deleted with the literal ``replace`` (faster);
the few that hold ``.`` or ``(`` go through ``regexp_replace``.

Regex dialect notes (Java vs Python ``re``):
  * ``(?d)`` (UNIX_LINES) makes ``.`` stop only at ``\\n``, as in Python.
  * ``(?U)`` makes ``\\d``/``\\s`` Unicode-aware, as in Python; Python's ``\\s`` also
    matches the separators ``\\x1c``-``\\x1f``, added explicitly.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical output).
# Administrative phrases deleted from note text, in application order.
# Profile "icd" (note-cleaning for the ICD classifier dataset):
ADMIN_PHRASES_ICD: tuple[str, ...] = (
    "FINAL REPORT",
    "Admission Date",
    "Discharge Date",
    "Date of Birth",
    "Phone",
    "Date/Time",
    "ID",
    "Completed by",
    "Dictated By",
    "Attending",
    "Provider: ",
    "Provider",
    "Primary",
    "Secondary",
    " MD Phone",
    " M.D. Phone",
    " MD",
    " PHD",
    " X",
    " IV",
    " VI",
    " III",
    " II",
    " VIII",
    "JOB#",
    "JOB#: cc",
    "# Code",
    "Metoprolol Tartrate 25 mg Tablet Sig",
    ")",
    "000 unit/mL Suspension Sig",
    "0.5 % Drops ",
    "   Status: Inpatient DOB",
    "Levothyroxine 50 mcg Tablet Sig",
    "0.5 % Drops Sig",
    "Lidocaine 5 %(700 mg/patch) Adhesive Patch",
    "Clopidogrel Bisulfate 75 mg Tablet Sig",
    "Levofloxacin 500 mg Tablet Sig",
    "Albuterol 90 mcg/Actuation Aerosol ",
    "None Tech Quality: Adequate Tape #",
    "000 unit/mL Solution Sig",
    " x",
    " am",
    " pm",
)
# Profile "mlm" (pretraining corpus): the same list without "FINAL REPORT".
ADMIN_PHRASES_MLM: tuple[str, ...] = ADMIN_PHRASES_ICD[1:]

# Ordered substitution rules applied after phrase removal (pattern, replacement).
# The multi-newline rules can never fire once "\n" is replaced, kept for fidelity.
SUBSTITUTIONS: tuple[tuple[str, str], ...] = (
    ("\n", " "),
    ("\n\n", " "),
    ("\n\n\n", " "),
    ("w/", "with"),
    ("_", ""),
    ("#", ""),
)
# Characters deleted at the end of the "mlm" profile.
MLM_MARKS = '":'
# The 15 note categories accepted by the category filter.
NOTE_CATEGORIES: tuple[str, ...] = (
    "Case Management", "Consult", "Discharge summary", "ECG", "Echo",
    "General", "Nursing", "Nursing/other", "Nutrition", "Pharmacy",
    "Physician", "Radiology", "Rehab Services", "Respiratory", "Social Work",
)
# ---------------------------------------------------------------------------

_REGEX_META = set(".^$*+?{}[]\\|()")

DEID_PATTERN = r"(?d)\[.*?\]"
DIGITS_PATTERN = r"(?U)\d+"
WHITESPACE_PATTERN = r"(?U)[\s\x1c-\x1f]+"


def is_literal(pattern: str) -> bool:
    """True when the 2020 pandas rule treats ``pattern`` as a plain substring."""
    return len(pattern) == 1 or not any(c in _REGEX_META for c in pattern)


def _lit(s: str) -> Column:
    return F.lit(s)


def _group_only_literal(pattern: str) -> str | None:
    """The text matched by a pattern whose only metacharacters are plain groups.

    ``a(b)c`` matches exactly ``abc``; returns None when any other metacharacter (or a
    quantifier after a group) is present.
    """
    depth = 0
    out = []
    for i, ch in enumerate(pattern):
        if ch == "(":
            if pattern[i + 1:i + 2] == "?":
                return None
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth < 0 or pattern[i + 1:i + 2] in ("*", "+", "?", "{"):
                return None
        elif ch in _REGEX_META:
            return None
        else:
            out.append(ch)
    return "".join(out) if depth == 0 else None


def replace_pattern(c: Column, pattern: str, replacement: str = "") -> Column:
    """One ``str.replace(pattern, replacement)`` step with 2020 pandas semantics."""
    if is_literal(pattern):
        return F.replace(c, _lit(pattern), _lit(replacement))
    plain = _group_only_literal(pattern)
    if plain is not None and "$" not in replacement and "\\" not in replacement:
        return F.replace(c, _lit(plain), _lit(replacement))
    # Java and Python agree on the metacharacters used by the fixed phrase lists;
    # (?d) keeps "." from matching "\r" like Python.
    java_repl = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, _lit("(?d)" + pattern), _lit(java_repl))


def strip_deid(c: Column) -> Column:
    """Delete de-identification marks ``[** ... **]`` (non-greedy, not across lines)."""
    return F.regexp_replace(c, _lit(DEID_PATTERN), _lit(""))


def word_pattern(phrase: str) -> str:
    """The phrase (trimmed) as a whole-word Java regex: not glued to a letter or digit."""
    core = phrase.strip()
    body = re.escape(core) if is_literal(phrase) else core
    return r"(?d)(?<!\w)" + body + r"(?!\w)"


def strip_phrases(c: Column, phrases: Sequence[str] = ADMIN_PHRASES_ICD,
                  word_boundary: bool = False) -> Column:
    """Delete each phrase in list order (case-sensitive substring by default).

    ``word_boundary=True`` (extension, off by default) deletes a phrase only as a whole
    word, so ``" X"`` no longer turns ``XRAY`` into ``RAY``.
    """
    for p in phrases:
        if word_boundary and p.strip():
            c = F.regexp_replace(c, _lit(word_pattern(p)), _lit(""))
        else:
            c = replace_pattern(c, p, "")
    return c


def substitute(c: Column, rules: Sequence[tuple[str, str]] = SUBSTITUTIONS) -> Column:
    """Ordered substitution rules."""
    for pat, repl in rules:
        c = replace_pattern(c, pat, repl)
    return c


def strip_digits(c: Column) -> Column:
    """T4: delete runs of (Unicode) digits."""
    return F.regexp_replace(c, _lit(DIGITS_PATTERN), _lit(""))


def collapse_ws(c: Column) -> Column:
    """T5: every whitespace run becomes one space (Python ``\\s`` set)."""
    return F.regexp_replace(c, _lit(WHITESPACE_PATTERN), _lit(" "))


def trim_text(c: Column) -> Column:
    """Strip both ends (after T5 only single spaces remain at the ends)."""
    return F.trim(c)


def strip_marks(c: Column, marks: str = MLM_MARKS) -> Column:
    """Delete the quote and colon characters."""
    return F.translate(c, marks, "")


def clean_text(c: Column, profile: str = "icd", lower: bool = False,
               word_boundary: bool = False) -> Column:
    """The full cleaning chain T1 -> T2 -> T3 -> T4 -> T5 -> (T6 | T7).

    ``lower`` (T11) is the optional lower-casing that the reference leaves switched off.
    """
    if profile not in ("icd", "mlm"):
        raise ValueError(f"unknown cleaning profile {profile!r}")
    if lower:
        c = F.lower(c)
    c = strip_deid(c)
    c = strip_phrases(c, ADMIN_PHRASES_ICD if profile == "icd" else ADMIN_PHRASES_MLM,
                      word_boundary=word_boundary)
    c = substitute(c)
    c = strip_digits(c)
    c = collapse_ws(c)
    return trim_text(c) if profile == "icd" else strip_marks(c)


def append_newline(c: Column) -> Column:
    """Text + newline (the corpus line terminator)."""
    return F.concat(c, _lit("\n"))


def pair_text(a: Column, b: Column, sep: str = "") -> Column:
    """Premise and hypothesis joined; the reference uses no separator."""
    return F.concat(a, _lit(sep), b) if sep else F.concat(a, b)


def trim_category(c: Column) -> Column:
    """Category compared after stripping white space (the T5 class) from both ends."""
    ws = f"(?:{WHITESPACE_PATTERN})"
    return F.regexp_replace(c, _lit(f"^{ws}|{ws}$"), _lit(""))


def prefix_path(root: str, c: Column) -> Column:
    """Root folder + relative path."""
    return F.concat(_lit(root), c)


def is_corpus_line(c: Column, min_chars: int = 10) -> Column:
    """A usable corpus line is longer than ``min_chars`` and not blank."""
    return (F.length(c) > min_chars) & (F.trim(F.regexp_replace(c, _lit(WHITESPACE_PATTERN), _lit(" "))) != "")


# --- DuckDB twins used by the oracle SQL --------------------------------------------

def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duckdb_clean_sql(expr: str, profile: str = "icd") -> str:
    """The same chain as :func:`clean_text` written as a DuckDB SQL expression.

    RE2 has no Unicode ``\\s``/``\\d``; the fixtures hold only ASCII digits and
    ASCII whitespace, so ASCII classes give the same result there.
    """
    e = f"regexp_replace({expr}, '\\[.*?\\]', '', 'g')"
    phrases = ADMIN_PHRASES_ICD if profile == "icd" else ADMIN_PHRASES_MLM
    for p in phrases:
        if is_literal(p):
            e = f"replace({e}, {sql_literal(p)}, '')"
        else:
            e = f"regexp_replace({e}, {sql_literal(p)}, '', 'g')"
    for pat, repl in SUBSTITUTIONS:
        e = f"replace({e}, {sql_literal(pat)}, {sql_literal(repl)})"
    e = f"regexp_replace({e}, '[0-9]+', '', 'g')"
    e = f"regexp_replace({e}, '\\s+', ' ', 'g')"
    if profile == "icd":
        e = f"trim({e})"
    else:
        e = f"replace(replace({e}, '\"', ''), ':', '')"
    return e
