"""Scalar text functions on code: columns in, columns out. Python's white space is Unicode's, so patterns take (?U)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that are lower-cased, and identifiers that are never renamed.
CASE_KEYWORDS = (
    "if else elif for while def class import from return try except finally with as lambda and or not in is "
    "int char float double void bool string public private protected static const final abstract virtual override "
    "function var let this new typeof instanceof"
).split()
CPP_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict "
    "return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary bool catch "
    "class constexpr const_cast delete dynamic_cast explicit export false friend mutable namespace new nullptr operator private "
    "protected public reinterpret_cast static_assert static_cast template this throw true try typeid typename using virtual wchar_t"
).split()
CPP_SPECIAL = (
    "main printf scanf malloc free realloc calloc memcpy memset strlen strcmp strcpy strcat fopen fclose fread fwrite fprintf fscanf "
    "FILE NULL size_t ptrdiff_t time_t clock_t va_list jmp_buf std string vector map set list queue stack deque array bitset iostream "
    "istream ostream cin cout cerr clog stringstream fstream ifstream ofstream algorithm iterator exception thread mutex chrono"
).split()
#: Literals without backtracking: a long one must not overflow the stack.
SINGLE, DOUBLE = r"'[^\\']*+(?:\\.[^\\']*+)*+'", r'"[^\\"]*+(?:\\.[^\\"]*+)*+"'
BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once: an expression that a lambda takes from outside is made anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def remove_comments(s: Column) -> Column:
    """Five deletions in turn, unaware of literals: // and # to the line's end, block comments, triple-quoted spans."""
    for pattern in (r"//[^\n]*", r"#[^\n]*", r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''"):
        s = F.regexp_replace(s, pattern, "")
    return s


def _indent(line: Column) -> Column:
    """Columns of leading white space, with tab stops of 4."""
    lead = F.regexp_extract(line, rf"(?U)\A({BLANK}*)", 1)
    step = lambda n, c: F.when(c == "\t", (F.floor(n / 4) + 1) * 4).otherwise(n + 1).cast("int")
    return F.when(lead == "", 0).otherwise(F.aggregate(F.split(lead, ""), F.lit(0), step))


def standardize_whitespace(s: Column) -> Column:
    """Lines end without blanks, indents are whole levels of 4, three and more newlines become two."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, rf"(?U){BLANK}+\z", "")
        return F.concat(F.repeat(F.lit("    "), F.floor(_indent(x) / 4).cast("int")), F.regexp_replace(x, rf"(?U)\A{BLANK}+", ""))

    joined = F.array_join(F.transform(F.split(s, "\n"), line), "\n")
    return strip(F.regexp_replace(joined, rf"(?U)\n{BLANK}*\n{BLANK}*\n+", "\n\n"))


def normalize_case(s: Column) -> Column:
    """Keywords as whole words, in any case and wherever they stand, become lower-case."""
    words = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(CASE_KEYWORDS), F.lower(w)).otherwise(w)), "")


def preprocess(s: Column, abstracted: Column | None = None, batch: bool = False) -> Column:
    """Abstraction or P1 (in a batch P1 in any case), then P2 and P3. Null and empty stay as they are."""
    text = s if abstracted is None else abstracted
    if abstracted is None or batch:
        text = remove_comments(text)
    return F.when(s.isNull() | (s == ""), s).otherwise(normalize_case(standardize_whitespace(text)))


def normalize(s: Column) -> Column:
    """Without carriage returns, tabs and blanks, in lower case."""
    return F.lower(F.translate(s, "\r\t ", ""))


def strip_comments(s: Column) -> Column:
    """Comments go and literals stay; runs of braces at a token's start go too. An open block comment stays."""
    tokens = F.regexp_extract_all(s, F.lit(rf"""(?s)(//[^\n]*+|[{{}}]++|/\*.*?\*/|{SINGLE}|{DOUBLE}|.[^/'"]*+)"""), F.lit(1))
    comment = lambda t: t.startswith("//") | t.rlike(r"\A[{}]") | (t.startswith("/*") & t.endswith("*/") & (F.length(t) >= 4))
    return F.array_join(F.filter(tokens, lambda t: ~comment(t)), "")


_COMMENTS = tuple((mark, re.compile(pattern)) for mark, pattern in (("//", r"//[^\n]*"), ("#", r"#[^\n]*"), ("/*", r"(?s)/\*.*?\*/"), ('"""', r'(?s)""".*?"""'), ("'''", r"(?s)'''.*?'''")))
_GAPS, _WORD, _CASES = re.compile(r"\n\s*\n\s*\n+"), re.compile(r"(?<!\w)(?=\w*[A-Z])\w+"), frozenset(CASE_KEYWORDS)


def without_comments(s: str) -> str:
    """remove_comments() of a plain value."""
    for mark, pattern in _COMMENTS:
        if mark in s:
            s = pattern.sub("", s)
    return s


def spaced(s: str) -> str:
    """standardize_whitespace() of a plain value."""
    out = []
    for line in s.split("\n"):
        line = line.rstrip()
        bare_line, indent = line.lstrip(), 0
        for c in line[: len(line) - len(bare_line)]:
            indent = (indent // 4 + 1) * 4 if c == "\t" else indent + 1
        out.append("    " * (indent // 4) + bare_line)
    return _GAPS.sub("\n\n", "\n".join(out)).strip()


def cased(s: str) -> str:
    """normalize_case() of a plain value. A keyword in another case has a capital letter of A to Z."""
    return _WORD.sub(lambda m: low if (low := m[0].lower()) in _CASES else m[0], s)


_CODE = re.compile(rf"""(?s)//[^\n]*+|[{{}}]++|/\*.*?\*/|{SINGLE}|{DOUBLE}|.[^/'"]*+""")


def bare(s: str) -> str:
    """strip_comments() of a plain value."""
    if not ("/" in s or "'" in s or '"' in s):
        return s.lstrip("{}")
    return "".join([t for t in _CODE.findall(s) if not (t[0] in "{}" or t.startswith("//") or t.startswith("/*") and t.endswith("*/") and len(t) >= 4)])


def normal(s: str) -> str:
    """normalize() of a plain value."""
    return s.replace("\r", "").replace("\t", "").replace(" ", "").lower()


def _comments_to_blanks(s: Column) -> Column:
    tokens = F.regexp_extract_all(s, F.lit(rf"""(?s)(//[^\n]*+|/\*.*?\*/|{SINGLE}|{DOUBLE}|[^/'"]++|.)"""), F.lit(1))
    comment = lambda t: t.startswith("//") | (t.startswith("/*") & t.endswith("*/") & (F.length(t) >= 4))
    return F.array_join(F.transform(tokens, lambda t: F.when(comment(t), " ").otherwise(t)), "")


def comments_to_blanks(s: Column, keep_indent: bool = False) -> Column:
    """P10; with keep_indent P11 and P12: a comment becomes a blank, empty lines go, others are stripped or keep their indent."""
    lines = F.split(_comments_to_blanks(s), "\n")
    lines = F.filter(lines, lambda x: strip(x) != "") if keep_indent else F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.array_join(lines, "\n")


def erase_whitespace(s: Column) -> Column:
    """P13."""
    return F.regexp_replace(s, rf"(?U){BLANK}+", "")


def language_of(path: Column) -> Column:
    """By the extension; c where it is unknown."""
    ext = F.element_at(F.split(F.lower(path), r"\."), -1)
    return F.when(ext.isin("cpp", "cc", "cxx", "c++"), "cpp").when(ext == "java", "java").otherwise("c")


def owner_repo(url: Column) -> Column:
    """The last two parts of a URL's path."""
    parts = F.split(F.regexp_replace(url, "^/+|/+$", ""), "/")
    return F.struct(F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("repo"))


def basename(path: Column) -> Column:
    """P16."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The basename without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def clean_json(s: Column) -> Column:
    """What stands between the markers, else between the outer braces; without fences; Python's words become JSON's."""
    first, last = "=== JSON RESPONSE ===", "=== END JSON ==="
    a, b = F.instr(s, first), F.instr(s, last)
    marked = F.substring(s, a + len(first), F.greatest(b - a - len(first), F.lit(0)))
    text = F.when((a > 0) & (b > 0), marked).otherwise(F.regexp_extract(s, r"(?s)(\{.*\})", 1))
    for x, y in (("```json", ""), ("```", ""), ("True", "true"), ("False", "false"), ("None", "null")):
        text = F.replace(text, F.lit(x), F.lit(y))
    return strip(text)


def prompt(vulnerable: Column, fixed: Column, clone: Column) -> Column:
    """A question about three bodies, whose answer is to be JSON between markers."""
    shape = '{"is_vulnerable": bool, "confidence_level": 1 to 5, "justification": string}'
    return F.concat(
        F.lit("Does the copy have the flaw that the fix removes? Calling the flawed function is no flaw.\n\nVULNERABLE:\n"), vulnerable, F.lit("\n\nFIXED:\n"), fixed,
        F.lit("\n\nCOPY:\n"), clone, F.lit(f"\n\nAnswer only with\n=== JSON RESPONSE ===\n{shape}\n=== END JSON ===\n"),
    )


def first_line(s: Column) -> Column:
    """P19."""
    return strip(F.split_part(s, F.lit("\n"), F.lit(1)))


def renameable(name: Column) -> Column:
    """P20: an identifier that is neither a keyword nor of the standard library."""
    return name.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_]*\z") & ~name.isin(CPP_KEYWORDS + CPP_SPECIAL)


def numeric_type(s: Column) -> Column:
    """Whether Python's int() takes it."""
    return F.coalesce(s.rlike(r"(?U)\A\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z"), F.lit(False))


def or_default(s: Column, default: str = "Not specified") -> Column:
    """P22."""
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))
