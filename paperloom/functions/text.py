"""Scalar text expressions.  All are Catalyst columns; none starts a Python worker."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


#: The characters of Unicode's White_Space property.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(x: Column, fn) -> Column:
    """fn of x, with x evaluated once however often fn names it."""
    return F.get(F.transform(F.array(x), fn), 0)


def strip(x: Column) -> Column:
    """Without white space (Unicode) at either end.

    Text between two visible ASCII characters stays as it is: trimming a set of characters looks at all of a text.
    """

    def made(v: Column) -> Column:
        seen = lambda at: F.substring(v.cast("binary"), at, 1).between(F.lit(bytearray(b"!")), F.lit(bytearray(b"~")))
        return F.when(seen(-1) & seen(1), v).otherwise(F.btrim(v, F.lit(WHITE_SPACE)))

    return made(x) if re.fullmatch(r"Column<'[\w.()]+(\[\w+\])*'>", str(x)) else let(x, made)


def high(characters: str) -> str:
    """The pattern of one of these characters, all beyond ASCII: ASCII is ruled out by one test, not by one for each of them."""
    return rf"[\x{{80}}-\x{{10FFFF}}&&[{characters}]]"


def one_blank(x: Column, blank: str) -> Column:
    """Each run of a class of white space (``\\s`` or blank and tab) as one blank; single blanks are no matches."""
    return F.regexp_replace(x, rf"{blank}{{2,}}|[{blank}&&[^ ]]", " ")


def replace_all(x: Column, pairs) -> Column:
    return reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), pairs, x)


def matches_any(x: Column, patterns) -> Column:
    """Whether any pattern occurs; a pattern's own case flag stays its own.

    Anchored patterns are tried at the start only.  The others are searched where their first
    literal occurs in any case, which is far cheaper than an alternation at every position.
    """
    anchored = [p for p in patterns if re.match(r"(\(\?i\))?\^", p)]
    loose = [p for p in patterns if p not in anchored]
    words = [re.match(r"\(\?i\)([A-Za-z:]+)(?![A-Za-z:?*+{|])", p) for p in loose]
    any_of = lambda ps: "|".join(f"(?:{p})" for p in ps)
    tests = [may_begin(x, anchored) & x.rlike(f"^(?:{any_of(anchored)})")] if anchored else []
    if loose:
        found = x.rlike(any_of(loose))
        tests.append(let(F.lower(x), lambda low: contains_any(low, sorted({w[1].lower() for w in words}))) & found if all(words) else found)
    return reduce(lambda a, b: a | b, tests)


def may_begin(x: Column, anchored) -> Column:
    """False only where the first character rules out every one of the anchored patterns; far cheaper than they are."""
    firsts = [re.match(r"(?:\(\?i\))?\^(?:(\\d)|([A-Za-z©])(?![*?{|]))", p) for p in anchored]
    if not all(firsts):
        return F.lit(True)
    known = {c for m in firsts for c in ("0123456789" if m[1] else m[2].lower() + m[2].upper())}
    return F.lit("".join(sorted(known))).contains(F.substring(x, 1, 1))


def begins(x: Column, *words: str) -> Column:
    """Whether the text begins with one of these words in lower case, in any case; only its beginning is looked at."""
    return let(F.lower(F.substring(x, 1, max(map(len, words)))), lambda low: starts_any(low, words))


def starts_any(x: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [x.startswith(p) for p in prefixes])


def contains_any(x: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(p) for p in parts])


def is_upper(x: Column) -> Column:
    """Has a cased letter and none in lower case."""
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")


def basic_clean(x: Column) -> Column:
    """Ligatures, quotes and dashes, (cid:n) marks, runs of blanks."""
    plain = let(x, lambda v: F.when(F.length(v) == F.octet_length(v), v).otherwise(replace_all(v, (*C.LIGATURES, *C.UNICODE_FIXES))))  # the characters are none of ASCII
    y = let(plain, lambda v: F.when(v.contains("(cid:"), F.regexp_replace(v, r"\(cid:\d+\)", "")).otherwise(v))
    return strip(one_blank(y, "[ \t]"))


def strip_unsafe(x: Column) -> Column:
    """Without combining marks, private use, U+FFFD and what lies beyond the basic plane."""
    return F.regexp_replace(x, high("\u0300-\u036f\ue000-\uf8ff\ufffd\uffff\\x{10000}-\\x{10FFFF}"), "")


def plain_scripts(x: Column) -> Column:
    """Raised and lowered digits as plain ones, minus and en dash as hyphen."""
    return F.translate(x, C.SUPERSCRIPTS + C.SUBSCRIPTS + "\u2212\u2013", C.SUPERSCRIPT_VALUES + C.SUBSCRIPT_VALUES + "--")


def join_decimals(x: Column) -> Column:
    return F.regexp_replace(x, r"(\d)\s*\.\s*(\d)", "$1.$2")


def clean_reference(x: Column) -> Column:
    y = F.regexp_replace(basic_clean(x), r"\.\.+$", ".")
    y = F.replace(F.replace(y, F.lit(" · "), F.lit(", ")), F.lit("·"), F.lit(", "))
    return strip(F.regexp_replace(F.translate(y, C.SUPERSCRIPTS, ""), r"(?U)\s+", " "))


def merge_math(x: Column) -> Column:
    """Adjacent inline formulas become one; a command takes its argument in."""
    y = F.regexp_replace(x, r"\$\s*\$", " ")
    y = F.regexp_replace(y, r"\$\s*([+\-=<>×÷·,])\s*\$", " $1 ")
    return F.when(x.contains("$"), F.regexp_replace(y, r"\$(\\\w+)\$(\([^)]{1,20}\))", r"\$$1$2\$")).otherwise(x)


def is_metadata(x: Column) -> Column:
    """Blank, or any metadata pattern occurs."""
    return let(strip(x), lambda y: (y == "") | matches_any(y, C.METADATA_PATTERNS))


def is_heading_line(x: Column) -> Column:
    short = lambda y: y.rlike(r"^\d+\.?\d*\.?\d*\.?\s+\p{Lu}") | F.lower(y).isin(*C.KEYWORD_HEADINGS)
    return let(strip(x), lambda y: (F.length(y) <= 80) & short(y))


def heading(x: Column, size: Column | None = None, body: Column | None = None, metadata: Column | None = None) -> Column:
    """struct(text, depth), or null: numbered, roman, keyword, or large print.

    ``metadata``: whether it or its first line is metadata, where that is known.  What begins otherwise and is 60 characters long or more is none, so nothing else of it is looked at.
    """
    may = lambda y: F.lit("0123456789IVXivx").contains(F.substring(y, 1, 1)) | (F.length(y) < 60)
    return let(strip(x), lambda y: F.when(may(y), _heading(y, size, body, metadata)))


def _heading(y: Column, size: Column | None, body: Column | None, metadata: Column | None) -> Column:
    number, rest = F.regexp_extract(y, r"^(\d+\.?\d*\.?\d*\.?)\s+(.+)$", 1), strip(F.regexp_extract(y, r"^(\d+\.?\d*\.?\d*\.?)\s+(.+)$", 2))
    trimmed = F.regexp_replace(number, r"\.+$", "")
    depth = F.least(F.length(trimmed) - F.length(F.replace(trimmed, F.lit("."), F.lit(""))) + 1, F.lit(3))
    out = F.when(is_metadata(y) | y.contains("\n") & is_metadata(F.substring_index(y, "\n", 1)) if metadata is None else metadata, None)
    header = rest.rlike(r"(?i)Page\s+\d+\s+of\s+\d+|Machine\s+Learning\s+\(\d{4}\)")
    ok = (F.length(rest) <= 80) & rest.rlike(r"\p{L}") & ~header
    roman = strip(F.regexp_extract(y, r"^([IVXivx]+\.?)\s+(.+)$", 2))
    larger = F.lit(False) if size is None else size > 1.1 * body
    out = out.when(number != "", F.when(ok, F.struct(rest.alias("text"), depth.alias("depth"))))
    titled = (roman != "") & (F.lower(roman).isin(*C.KEYWORD_HEADINGS) | larger) & ~roman.rlike(r"(?i)Page\s+\d+\s+of\s+\d+")
    out = out.when(titled, F.struct(roman.alias("text"), F.lit(1).alias("depth")))
    out = out.when(F.lower(y).isin(*C.KEYWORD_HEADINGS) & (F.length(y) < 40), F.struct(y.alias("text"), F.lit(1).alias("depth")))
    if size is not None:
        large = (body > 0) & (size > 1.15 * body) & (F.length(y) < 60) & y.rlike(r"^\p{Lu}") & ~y.endswith(",")
        out = out.when(large, F.struct(y.alias("text"), F.lit(1).alias("depth")))
    return out


def real_words(x: Column, least: int = 4) -> Column:
    """How many words are letters only, long enough and not in the stop list."""
    words = F.split(x, r"\s+")
    return F.size(F.filter(words, lambda w: w.rlike(rf"^\p{{L}}{{{least},}}$") & ~F.lower(w).isin(*C.STOP_WORDS)))


def author_names(x: Column) -> Column:
    y = F.regexp_replace(x, "[¹²³⁴⁵⁶⁷⁸⁹⁰0-9*†‡§]", "")
    parts = F.when(y.contains(","), F.split(y, ",")).when(F.lower(y).contains(" and "), F.split(y, r"(?i)\s+and\s+")).when(y.rlike("[·•]"), F.split(y, "[·•]")).otherwise(F.array(y))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def plausible_author(x: Column) -> Column:
    y, low = strip(x), F.lower(strip(x))
    bad = y.rlike(r"^\p{Ll}") | is_upper(y) & (F.length(y) > 5) | contains_any(low, (*C.AFFILIATION_WORDS, "the ", "ieee", "acm"))
    return F.length(y).between(3, 60) & ~bad & (F.size(F.split(y, r"\s+")) >= 2)


def bad_author(x: Column) -> Column:
    y, low = strip(x), F.lower(strip(x))
    words = ("university", "institute", "department", "ieee", "acm", "conference", "journal", "proceedings")
    return (F.length(y) < 3) | starts_any(low, ("the ", "a ", "an ")) | contains_any(low, words) | y.rlike(r"^[A-Z]{2,}\s+[A-Z]{2,}$")


def junk_reference(x: Column) -> Column:
    """Not a reference: headers, licences, addresses, numbers, or too short without a bracket number."""

    def junk(y: Column) -> Column:
        return matches_any(y, C.JUNK_REFERENCES) | y.contains("(") & F.lower(y).rlike(r"^[a-z\s]+ +\(\d{4}\)\s*\d+:\d+") | y.contains("·") & y.rlike("[¹²³⁴⁵⁶⁷⁸⁹⁰]") | (F.length(y) < 15) & ~y.rlike(r"^\[\d+\]")

    return let(strip(x), junk)


def parse_reference(x: Column) -> Column:
    """struct(index, text): [n] text, n. Text, or a long line that starts in upper case (index null).

    Null for lines under 15 characters, junk, and numbers before junk.
    """
    return let(strip(x), _parsed)


def _parsed(y: Column) -> Column:
    bracket, dotted = r"^\[(\d+)\]\s*(.+)", r"^(\d+)\.\s+([A-Z].{20,})"

    def numbered(pattern: str) -> Column:
        index = F.regexp_extract(y, pattern, 1).cast("int").alias("index")
        return let(strip(F.regexp_extract(y, pattern, 2)), lambda text: F.when(~junk_reference(text), F.struct(index, text.alias("text"))))

    plain = F.struct(F.lit(None).cast("int").alias("index"), y.alias("text"))
    out = F.when((F.length(y) < 15) | junk_reference(y), None).when(y.rlike(bracket), numbered(bracket)).when(y.rlike(dotted), numbered(dotted))
    return out.when(y.rlike(r"^\p{Lu}") & (F.length(y) > 30), plain)


def keywords(x: Column) -> Column:
    """The list after a keyword prefix."""
    rest = lambda y: F.regexp_extract(y, r"(?i)^(?:keywords|key words|index terms)\s*[:\-—]?\s*(.+)$", 1)
    given = let(strip(x), lambda y: F.when(begins(y, "keywords", "key words", "index terms"), rest(y)).otherwise(""))
    return F.when(given != "", F.filter(F.transform(F.split(given, "[;,·•]"), lambda k: F.regexp_replace(strip(k), r"\.+$", "")), lambda k: k != "")).otherwise(F.array().cast("array<string>"))


def line_features(line: Column, size: Column | None = None, body: Column | None = None) -> dict[str, Column]:
    """Sixteen features of a line; a blank line has zeros."""
    y = strip(line)
    n = F.length(y)
    odd = n - F.length(F.regexp_replace(y, r"(?U)[^\p{L}\p{N}\s]", ""))
    ratio = F.when((body > 0) & (size > 0), size / body).otherwise(1.0) if size is not None else F.lit(1.0)
    flag = lambda c: c.cast("int")
    made = {
        "n_chars": n, "n_words": F.size(F.filter(F.split(y, r"(?U)\s+"), lambda w: w != "")), "first_upper": flag(y.rlike(r"^\p{Lu}")), "all_upper": flag(is_upper(y)),
        "has_digit": flag(y.rlike(r"\p{Nd}")), "first_digit": flag(y.rlike(r"^\p{Nd}")), "odd_share": F.round(odd / n, 6), "ends_dot": flag(y.endswith(".")),
        "numbered": flag(y.rlike(r"(?U)^\d+\.?\s+\w+")), "keyword": flag(F.lower(y).isin(*C.FEATURE_HEADINGS)), "email": flag(y.rlike(r"(?U)[\w.+-]+@[\w-]+\.\w+")),
        "url": flag(y.rlike("https?://")), "size_ratio": ratio, "short": flag(n < 50), "bracket": flag(y.rlike(r"[\[\]]")), "math": flag(y.rlike(f"[{C.FEATURE_SYMBOLS}]")),
    }
    zero = lambda k: F.lit(0.0) if k in ("odd_share", "size_ratio") else F.lit(0)
    return {k: F.when(y == "", zero(k)).otherwise(v) for k, v in made.items()}


def auto_label(line: Column) -> Column:
    y = strip(line)
    return F.when((F.length(y) < 50) & y.rlike(r"^\p{Lu}"), "heading").otherwise("body")


def math_count(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, high(C.MATH_CLASS), ""))
