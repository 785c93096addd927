"""Mathematics in running text and in table cells: scripts, subscripts, primes, wrapped lines, garbage tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import text as T
from .latex import let

UP, DOWN, MATH = T.high(C.SUPERSCRIPTS), T.high(C.SUBSCRIPTS), T.high(C.MATH_CLASS)
NEITHER = f"[^{C.SUPERSCRIPTS}{C.SUBSCRIPTS}]"
GREEK = T.high("".join(k for k, _ in C.GREEK) + "ς")
LETTER = f"[a-zA-Z{GREEK}]"


def outside(x: Column, fn) -> Column:
    """fn on what lies outside closed pairs of unescaped dollar signs; an unclosed tail is outside."""
    parts = F.split(x, r"(?<!\\)\$", -1)
    n = F.size(parts)
    each = lambda p, i: F.when((i % 2 == 1) & (i < n - 1), p).when(i % 2 == 1, F.substr(fn(F.concat(F.lit("$"), p)), F.lit(2))).otherwise(fn(p))
    return F.array_join(F.transform(parts, each), "$")


def each_formula(x: Column, fn) -> Column:
    """fn on the content between dollar signs; the content is what fn returns, dollar signs included."""
    tokens = F.regexp_extract_all(x, F.lit(r"(?s)(\$[^$]+\$|[^$]+|\$)"), 1)
    inner = lambda t: F.substr(t, F.lit(2), F.length(t) - 2)
    return F.when(x.contains("$"), F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"(?s)^\$[^$]+\$$"), fn(inner(t))).otherwise(t)), "")).otherwise(x)


def each_line(x: Column, fn) -> Column:
    return F.array_join(F.transform(F.split(x, "\n", -1), fn), "\n")


# ---- scripts ----------------------------------------------------------------------------------


def scripts(x: Column) -> Column:
    """Raised and lowered characters as $base^{..}$ and $base_{..}$; without a letter or digit before, $^{..}$.

    One tokenising pass marks every run, so that the characters can then be translated at once.
    """
    token = f"(?s)((?:(?!{NEITHER}(?:{UP}|{DOWN})){NEITHER})+|{NEITHER}{UP}+|{NEITHER}{DOWN}+|{UP}|{DOWN})"
    tokens = F.regexp_extract_all(x, F.lit(token), 1)

    def marked(t: Column) -> Column:
        y = F.regexp_replace(t, rf"^([\p{{L}}\p{{N}}])({UP}+)$", r"\$$1^{$2}\$")
        y = F.regexp_replace(y, rf"^([\p{{L}}\p{{N}}])({DOWN}+)$", r"\$$1_{$2}\$")
        y = F.regexp_replace(y, rf"(?s)^([^\p{{L}}\p{{N}}]?)({UP}+)$", r"$1\$^{$2}\$")
        return F.regexp_replace(y, rf"(?s)^([^\p{{L}}\p{{N}}]?)({DOWN}+)$", r"$1\$_{$2}\$")

    whole = F.array_join(F.transform(tokens, marked), "")
    return F.when(x.rlike(T.high(C.SUPERSCRIPTS + C.SUBSCRIPTS)), F.translate(whole, C.SUPERSCRIPTS + C.SUBSCRIPTS, C.SUPERSCRIPT_VALUES + C.SUBSCRIPT_VALUES)).otherwise(x)


def ascii_subscripts(x: Column) -> Column:
    """x_i as $x_{i}$ outside mathematics; longer words with underscores stay."""
    made = outside(x, lambda p: F.regexp_replace(p, r"(?<![a-zA-Z$])([a-zA-Z]{1,2})_([a-zA-Z0-9]{1,2})(?![a-zA-Z0-9_])", r"\$$1_{$2}\$"))
    return F.when(x.contains("_"), made).otherwise(x)


def greek_subscripts(x: Column) -> Column:
    """A letter before Greek letters with arguments takes them as its subscript."""
    found = rf"(?<![a-zA-Z])({LETTER})\s?((?:{GREEK}\([^)]{{1,10}}\)){{1,4}})"
    tokens = F.regexp_extract_all(x, F.lit(f"(?s)({found.replace('(' + LETTER + ')', LETTER).replace('((?:', '(?:(?:')}|.)"), 1)
    bare = lambda y: T.replace_all(y, C.GREEK)
    made = lambda t: F.concat(F.lit("$"), bare(F.regexp_extract(t, found, 1)), F.lit("_{"), bare(F.regexp_extract(t, found, 2)), F.lit("}$"))
    whole = F.array_join(F.transform(tokens, lambda t: F.when(F.length(t) > 1, made(t)).otherwise(t)), "")
    return F.when(x.contains("(") & x.rlike(rf"{GREEK}\(") & x.rlike(rf"(?<!{LETTER}){LETTER} ?{GREEK}\("), whole).otherwise(x)


def implicit_subscripts(x: Column) -> Column:
    """aij as $a_{ij}$, A22 as $A_{22}$, ti as $t_{i}$ on lines that hold an equation; English words stay."""
    words = lambda w: rf"(?!(?i:{'|'.join(w)})(?![a-zA-Z]))"

    def line(y: Column) -> Column:
        symbol, assigned = y.rlike(T.high(C.CONTEXT_SYMBOLS)), y.contains("=") & y.rlike(r"=\s*\d")
        command = y.contains("\\") & y.rlike(r"\\(?:times|otimes|oplus|leq|geq|neq|approx|sim|in|subset|cdot|frac|sqrt|sum|prod|int)")
        some = symbol | assigned | command | y.contains("$") & y.rlike(r"[a-zA-Z]\s*[+\-=<>]\s*[a-zA-Z]")
        many = lambda v: outside(v, lambda p: F.regexp_replace(p, rf"(?<![a-zA-Z]){words(C.SUBSCRIPT_WORDS)}([a-zA-Z])([ijklmnpqrs]{{2,3}})(?![a-zA-Z])", r"\$$1_{$2}\$"))
        digits = lambda v: outside(v, lambda p: F.regexp_replace(p, r"(?<![a-zA-Z])([A-Za-z])(\d{1,3})(?![a-zA-Z0-9])", r"\$$1_{$2}\$"))
        single = lambda v: outside(v, lambda p: F.regexp_replace(p, rf"(?<![a-zA-Z]){words(C.SHORT_WORDS)}([a-zA-Z])([ijknmpq])(?![a-zA-Z])", r"\$$1_{$2}\$"))
        one = let(many(y), lambda v: F.when(symbol, digits(v)).otherwise(v))
        return F.when(some, let(one, lambda v: F.when(assigned | symbol, single(v)).otherwise(v))).otherwise(y)

    # A line with none of these stays as it is.
    return F.when(T.contains_any(x, ("=", "\\", "$")) | x.rlike(T.high(C.CONTEXT_SYMBOLS)), each_line(x, line)).otherwise(x)


# ---- lines and formulas -------------------------------------------------------------------------


def short_share(y: Column) -> Column:
    words = F.split(y, r"\s+")
    return F.size(F.filter(words, lambda w: F.length(w) <= 2)) / F.size(words)


def wrap_line(line: Column) -> Column:
    """A short line that is an equation, or continues one, between dollar signs.

    Lines that hold a dollar sign or begin an environment stay as they are.
    """

    def made(y: Column) -> Column:
        real = T.real_words(y)
        call = y.contains("(") & y.contains(")") | y.contains("||") | y.contains("‖") | y.rlike(r"\b(sin|cos|tan|log|exp|max|min|lim|sup|inf|Pr|arg)\s*[(\[]")
        equation = y.contains("=") & call & (real <= 1) & (short_share(y) >= 0.3)
        goes_on = y.rlike(r"^[=<>≤≥+\-]") & (real == 0)
        free = (y != "") & (F.length(y) < 80) & ~y.contains("$") & ~y.startswith("\\begin")
        return F.when(free & (equation | goes_on), F.concat(F.lit("$"), y, F.lit("$"))).otherwise(line)

    return let(T.strip(line), made)


def wrap_lines(x: Column) -> Column:
    return each_line(x, wrap_line)


def fix_primes(x: Column) -> Column:
    """Stray primes at and inside mathematics go, as two of them stop LaTeX; a prime after a letter or digit stays."""
    y = F.regexp_replace(F.regexp_replace(x, r"'\s*\$", r"\$"), r"\$\s*'", r"\$")

    def inner(c: Column) -> Column:
        for pattern in (r"^'\s*", r"\s*'$", r"'\s+'", r"(?<![a-zA-Z0-9])'\s*"):
            c = F.regexp_replace(c, pattern, "")
        return let(c, lambda v: F.when(T.strip(v) == "", "").otherwise(F.concat(F.lit("$"), v, F.lit("$"))))

    return F.when(x.contains("$"), F.regexp_replace(let(y, lambda v: each_formula(v, inner)), r"\$\s*\$", "")).otherwise(x)


def to_commands(x: Column, table) -> Column:
    """Symbols to commands, bare in formulas (no blanks added), wrapped elsewhere."""
    bare = [(k, v[1:-1] if v.startswith("$") else v) for k, v in table]
    wrapped = [(k, v if v.startswith("$") else f"${v}$") for k, v in table]
    some = T.high("".join(k for k, _ in table))
    return F.when(x.rlike(some), T.replace_all(each_formula(x, lambda c: F.concat(F.lit("$"), T.replace_all(c, bare), F.lit("$"))), wrapped)).otherwise(x)


def after_equations(x: Column) -> Column:
    """The steps of the mathematics cleaner that follow the numbered equations, in their order."""
    steps = (greek_subscripts, lambda y: to_commands(y, C.GREEK), lambda y: to_commands(y, C.SYMBOLS), scripts, ascii_subscripts, implicit_subscripts,
             lambda y: F.regexp_replace(y, r"(\d)\s*\.\s*(\d)", "$1.$2"), wrap_lines, T.merge_math, fix_primes, T.strip_unsafe)
    for step in steps:
        x = let(x, step)
    return x


# Formulas of table cells: pattern and what it becomes, special ones first.
CELL_FORMULAS = (
    (r"\b([a-zA-Z])(\d)\s*\+\s*([a-zA-Z])(\d)\s*=\s*([a-zA-Z])(\d)\b", r"\$$1^{$2} + $3^{$4} = $5^{$6}\$"),
    (r"\blog\s*\(([^)]+)\)\s*=\s*log\s*\(([^)]+)\)\s*\+\s*log\s*\(([^)]+)\)", r"\$\\log($1) = \\log($2) + \\log($3)\$"),
    (r"\bdf\s*/\s*dt\s*=\s*lim", r"\$\\frac{df}{dt} = \\lim_{h \\to 0} \\frac{f(t+h) - f(t)}{h}\$"),
    (r"\bF\s*=\s*G\s*m\s*1\s*m\s*2\s*/\s*r\s*2\b", r"\$F = G\\frac{m_1 m_2}{r^{2}}\$"),
    (r"\bi\s*2\s*=\s*[−\-]\s*1\b", r"\$i^{2} = -1\$"),
    (r"\bE\s*=\s*mc\s*2\b", r"\$E = mc^{2}\$"),
    (r"\b([A-Z])\s*=\s*([a-z]+)\s*(\d)\b", r"\$$1 = $2^{$3}\$"),
    (r"\b([a-z])(\d)\s*=\s*([−\-]?\d+)\b", r"\$$1^{$2} = $3\$"),
)


def clean_cell(x: Column) -> Column:
    """A table cell: plain scripts, cleaned, known formulas, symbols as commands, formulas merged.

    Prefixes such as "f^(w) =" that a formula table would only delete stay in the cell.
    """
    y = T.basic_clean(T.plain_scripts(F.coalesce(x, F.lit(""))))
    for pattern, to in CELL_FORMULAS:
        y = F.regexp_replace(y, pattern, to)
    for table in (C.GREEK, C.SYMBOLS):
        y = T.replace_all(y, [(k, v if v.startswith("$") else f"${v}$") for k, v in table])
    return T.strip_unsafe(T.merge_math(y))


# ---- what extraction leaves of display equations ---------------------------------------------------

OPERATORS = r"[=+\-*/(){}\[\]|,;:.<>^_\\¯]"


def counted(x: Column, pattern: str) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, pattern, ""))


def plain_equation(y: Column) -> Column:
    """Under 60 characters with letters on both sides of the relation that is tried first."""
    sides = F.lit(False)
    for sign in reversed("=≤≥≈"):
        sides = F.when(y.contains(sign), y.rlike(f"(?s)^[^{sign}]*[a-zA-Z][^{sign}]*{sign}.*[a-zA-Z]")).otherwise(sides)
    return (F.length(y) < 60) & sides


def garbled(line: Column) -> Column:
    """A line of a display equation that extraction scrambled (up to 150 characters)."""

    def test(y: Column) -> Column:
        n, real = F.length(y), T.real_words(y)
        sure = y.contains("· · ·") | y.contains("...") & (y.contains("k(") | y.contains("||")) | (F.regexp_count(y, F.lit(r"[a-zA-Z]\([^)]{1,20}\)")) >= 3)
        sure |= y.rlike(r"\|\|.*\|\|") | y.rlike(r"(?iU)^[\w\s\-+()]*\bterms\b\s*$") | y.startswith("=") & (n < 100) & (real <= 1)
        chars = F.replace(y, F.lit(" "), F.lit(""))
        share = (counted(chars, MATH) + counted(chars, OPERATORS) + counted(chars, r"[\p{Nd}¹²³]")) / F.greatest(F.length(chars), F.lit(1))
        return (y != "") & (n <= 150) & ~plain_equation(y) & (sure | (n < 80) & (real <= 1) & (share > 0.35))

    return let(T.strip(line), test)


def fragment(line: Column) -> Column:
    """A line of at most 60 characters of single symbols, letters and operators."""

    def test(y: Column) -> Column:
        chars = F.replace(y, F.lit(" "), F.lit(""))
        total, math, ops = F.length(chars), counted(chars, MATH), counted(chars, OPERATORS)
        symbols = (math > 0) & (math + ops >= total * 0.5) & (total <= 20)
        letters = (F.size(F.split(y, r"\s+")) >= 2) & (short_share(y) >= 0.6) & (total <= 40) & (T.real_words(y) == 0)
        return (y != "") & (F.length(y) <= 60) & ~plain_equation(y) & (y.rlike(r"^\(\d+\)$") | symbols | letters | (ops >= total * 0.6) & (total <= 25))

    return let(T.strip(line), test)


def orphan(line: Column) -> Column:
    """A short line of symbols, indices or single letters that belongs to a neighbouring line.

    Whole equations, equation labels and numbers of four digits or more do not.
    """

    def test(y: Column) -> Column:
        bare = F.regexp_replace(y, "[ ,()]", "")
        plain = rf"(?:{MATH}|\p{{N}}|[.;:=+*/^_{{}}|\[\]<>-])"
        made = bare.rlike(f"^{plain}+$") | (F.length(bare) <= 6) & bare.rlike(rf"^(?:{plain}|\p{{L}})+$")
        words = F.forall(F.split(y, r"\s+"), lambda w: (F.length(w) <= 3) | w.rlike(MATH))
        variables = F.size(F.filter(F.split(F.regexp_replace(y, "[()]", " "), r"\s+"), lambda w: w.rlike(r"^\p{L}{1,3}$")))
        whole = y.rlike("[=≤≥<>≈∼]") & (variables >= 2)
        return (y != "") & (F.length(y) <= 15) & made & words & (T.real_words(y) == 0) & ~(bare.rlike(r"^\p{Nd}{4,}$")) & ~whole & ~y.rlike(r"^\(\d{1,3}\)$")

    return let(T.strip(line), test)
