"""Abstraction of identifiers. Symbols come as arrays, from any parser; symbols_of() is an approximation by patterns.

Names are looked up in dictionaries, text by text, so the work grows with a text's length. An expression
over arrays would search the list of names again for every token.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinseek.functions.text import CPP_KEYWORDS, CPP_SPECIAL, DOUBLE, SINGLE, bare, comments_to_blanks, let, normal

# Fixed values of the language configuration: keywords, modifiers, types and functions that are the language's own.
C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return "
    "short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary _Alignas _Alignof _Atomic "
    "_Static_assert _Noreturn _Thread_local _Generic true false NULL"
).split()
CPP_OWN_KEYWORDS = (
    "class namespace using template typename public private protected virtual override final new delete this operator friend explicit "
    "mutable constexpr decltype auto nullptr thread_local alignas static_assert noexcept try catch throw typeid dynamic_cast static_cast "
    "const_cast reinterpret_cast"
).split()
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for "
    "goto if implements import instanceof int interface long native new package private protected public return short static strictfp super "
    "switch synchronized this throw throws transient try void volatile while true false null"
).split()
C_TYPES = (
    "void char short int long float double signed unsigned _Bool _Complex _Imaginary size_t ptrdiff_t wchar_t wint_t int8_t int16_t int32_t "
    "int64_t uint8_t uint16_t uint32_t uint64_t intptr_t uintptr_t time_t clock_t FILE DIR"
).split()
CPP_TYPES = C_TYPES + (
    "string vector map set list queue stack pair shared_ptr unique_ptr weak_ptr array unordered_map unordered_set deque priority_queue "
    "bitset tuple function thread mutex condition_variable"
).split()
JAVA_TYPES = (
    "boolean byte char short int long float double String Object Integer Double Float Boolean Character Byte Short Long ArrayList HashMap "
    "HashSet TreeMap TreeSet LinkedList Vector Stack Queue PriorityQueue Properties Date Calendar Thread Runnable Exception RuntimeException"
).split()
C_MODIFIERS = "static extern register auto const volatile restrict inline unsigned signed _Thread_local _Atomic".split()
CPP_MODIFIERS = C_MODIFIERS + "public private protected virtual explicit mutable constexpr thread_local alignas noexcept".split()
JAVA_MODIFIERS = "public private protected static final abstract synchronized volatile transient native strictfp".split()
C_FUNCTIONS = (
    "printf scanf malloc free calloc realloc strlen strcpy strcat strcmp strncmp strstr memcpy memset memmove fopen fclose fread fwrite "
    "fprintf fscanf fgets fputs exit abort atexit system getenv qsort bsearch abs labs div ldiv rand srand atoi atol atof strtol strtoul "
    "strtod isalpha isdigit isalnum isspace tolower toupper sin cos tan log exp sqrt pow ceil floor"
).split()
CPP_FUNCTIONS = C_FUNCTIONS + (
    "cout cin endl begin end size empty push_back pop_back insert erase find clear sort reverse max min swap make_pair make_shared "
    "make_unique get move forward thread join detach lock unlock"
).split()
JAVA_FUNCTIONS = (
    "println print length charAt substring indexOf toLowerCase toUpperCase trim replace split equals compareTo hashCode toString valueOf "
    "parseInt parseDouble add remove get set size isEmpty contains clear iterator hasNext next put keySet values entrySet start run "
    "sleep wait notify notifyAll currentTimeMillis"
).split()
#: B2f: by language its keywords, types, functions and modifiers; others count as c.
CONFIG = {
    "c": (C_KEYWORDS, C_TYPES, C_FUNCTIONS, C_MODIFIERS),
    "cpp": (C_KEYWORDS + CPP_OWN_KEYWORDS, CPP_TYPES, CPP_FUNCTIONS, CPP_MODIFIERS),
    "java": (JAVA_KEYWORDS, JAVA_TYPES, JAVA_FUNCTIONS, JAVA_MODIFIERS),
}
CONTROL = "if for while switch return sizeof catch else do case".split()
NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
#: What policies of the three fixed abstractions generalise.
POLICIES = {1: ("parameters", "locals", "types", "calls"), 2: ("functions",), 3: ("functions", "parameters")}
LABELS = {"calls": "FUNCCALL", "types": "DTYPE", "functions": "FNAME", "locals": "LVAR", "parameters": "FPARAM"}
OWN_NAMES = frozenset(CPP_KEYWORDS + CPP_SPECIAL)


def by_text(make: Callable, kind: str = "string") -> Callable[..., Column]:
    """A function of columns from one of plain values; a null first value gives null. Rows come in small packs of Spark's, so
    memory does not grow with a partition."""

    def run(*row):
        return None if row[0] is None else make(*row)

    return F.udf(make if kind.startswith("struct") else run, kind, useArrow=False)


def tokens(s: Column) -> Column:
    """Names, numbers, whole literals, and single other characters; comments are left out."""
    every = F.regexp_extract_all(s, F.lit(rf"""(?s)(//[^\n]*+|/\*.*?\*/|{SINGLE}|{DOUBLE}|{NAME}|[0-9][0-9a-zA-Z_.]*+|\s++|.)"""), F.lit(1))
    return F.filter(every, lambda t: ~(t.startswith("//") | (t.startswith("/*") & t.endswith("*/") & (F.length(t) >= 4))))


def symbols_of(code: Column, language: str = "c") -> Column:
    """B2a-B2d by patterns, an approximation: struct<parameters, locals, types, calls, functions>, arrays of names.

    Parameters are plain names of the first parameter list, without pointers; locals are initialised declarations of a plain
    name; types stand before either; calls are names before a parenthesis that are no standard function.
    """
    _, _, own, modifiers = CONFIG.get(language, CONFIG["c"])
    plain = rf"\A\s*(?:{NAME}\s+)*?({NAME})\s+({NAME})\s*(?:\[[^\]]*\])?\s*\z"
    local = F.lit(rf"(?<![\w.>])({NAME})\s+({NAME})\s*=[^=]")
    named = lambda a: F.array_distinct(F.filter(a, lambda x: (x != "") & ~x.isin(CPP_KEYWORDS)))

    # No lambda uses a variable of one around it: Spark cannot take such an expression as an argument of a Python function.
    def of(flat: Column) -> Column:
        head = F.regexp_extract(flat, rf"(?s)\A[^({{;]*?({NAME})\s*\(([^)]*)\)", 2)
        function = F.regexp_extract(flat, rf"(?s)\A[^({{;]*?({NAME})\s*\(", 1)
        return let(F.struct(flat.alias("flat"), F.split(head, ",").alias("declared"), function.alias("function")), parts)

    def parts(x: Column) -> Column:
        parameters = named(F.transform(x["declared"], lambda d: F.regexp_extract(d, plain, 2)))
        types = F.array_union(F.transform(x["declared"], lambda d: F.regexp_extract(d, plain, 1)), F.regexp_extract_all(x["flat"], local, F.lit(1)))
        types = F.array_distinct(F.filter(types, lambda t: (t != "") & ~t.isin(modifiers + CONTROL)))
        calls = F.filter(named(F.regexp_extract_all(x["flat"], F.lit(rf"({NAME})\s*\("), F.lit(1))), lambda c: ~c.isin(own + CONTROL))
        locals_ = F.array_except(named(F.regexp_extract_all(x["flat"], local, F.lit(2))), parameters)
        return F.struct(parameters.alias("parameters"), locals_.alias("locals"), types.alias("types"), F.array_remove(calls, x["function"]).alias("calls"), F.array(x["function"]).alias("functions"))

    return let(comments_to_blanks(code), of)


def symbols_by(code: Column, tool: Callable[[str], dict[str, list[str]]]) -> Column:
    """U4: the symbols that an outside tool tells of each text, as symbols_of() gives them. What it does not tell is empty."""
    parts = ("parameters", "locals", "types", "calls", "functions")

    def of(text: str) -> dict:
        found = tool(text)
        return {p: list(found.get(p, [])) for p in parts}

    return by_text(of, "struct<" + ",".join(f"{p}:array<string>" for p in parts) + ">")(code)


def relabel(code: Column, symbols: Column, parts: tuple[str, ...] = ("calls", "types", "locals", "parameters")) -> Column:
    """B2, B2e: every token that is a known name gets its label, whatever its role; of several labels parameters win, then
    locals, types, calls. With other parts, B6-B8."""
    order = [p for p in LABELS if p in parts]
    labels = [LABELS[p] for p in order]

    def of(every, *names) -> str:
        known = {n: label for label, own in zip(labels, names) if own is not None for n in own}
        return "".join([known.get(t, t) for t in every])

    return by_text(of)(tokens(code), *(symbols[p] for p in order))


def abstract(code: Column, policy: int, language: str = "c") -> Column:
    """One of the three fixed policies, by the approximate symbols."""
    return relabel(code, symbols_of(code, language), POLICIES[policy])


#: So few names are searched for one by one; more are looked up in a dictionary of the text's words.
FEW = 12


def word_replaced(code: str, name: str, label: str) -> str:
    """in_turn() of one plain word."""
    out, last, taken = [], 0, -1
    at = code.find(name)
    while at >= 0:
        end = at + len(name)
        if at > taken and end < len(code) and not (code[end].isalnum() or code[end] == "_") and (at == 0 or not (code[at - 1].isalnum() or code[at - 1] == "_")):
            out.append(code[last:at])
            last, taken = end, end + 1
        at = code.find(name, end)
    return label.join([*out, code[last:]])


def in_turn(code: str, names: list[str], label: str) -> str:
    """replace_in_turn() of plain values. Plain words are found by their places, others by a pattern."""
    at = 0
    while at < len(names):
        if not re.fullmatch(r"\w+", names[at]):
            code = re.sub(rf"(^|\W){re.escape(names[at])}(\W)", rf"\g<1>{label}\g<2>", code) if names[at] else code
            at += 1
            continue
        run = at
        while run < len(names) and re.fullmatch(r"\w+", names[run]):
            run += 1
        if run - at <= FEW:
            for name in names[at:run]:
                code = word_replaced(code, name, label)
            at = run
            continue
        parts, places = re.findall(r"\w+|\W", code), {n: [] for n in names[at:run]}
        for i, part in enumerate(parts):
            if part in places:
                places[part].append(i)
        for name in names[at:run]:
            taken, left = -1, []
            for i in places[name]:
                if i + 1 < len(parts) and (i == 0 or i - 1 != taken):
                    parts[i], taken = label, i + 1
                    if label != name and label in places:
                        places[label].append(i)
                else:
                    left.append(i)
            if label != name:
                places[name] = left
            if label in places:
                places[label].sort()
        code, at = "".join(parts), run
    return code


def replace_in_turn(code: Column, names: Column, label: str) -> Column:
    """B1: each name in turn, between a character that is no word's (or the text's start) and another, both consumed, so of
    two occurrences with one character between them only the first is replaced."""
    return by_text(lambda text, own: in_turn(text, [] if own is None else list(own), label))(code, names)


def symbol_abstract(code: Column, parameters: Column, types: Column, locals_: Column) -> Column:
    """B1: parameters, then types, then locals."""

    def of(text: str, *names) -> str:
        for own, label in zip(names, ("FPARAM", "DTYPE", "LVAR")):
            text = in_turn(text, [] if own is None else list(own), label)
        return text

    return by_text(of)(code, parameters, types, locals_)


def abstracted_by_patterns(code: Column, language: str = "c") -> Column:
    """B1 with the symbols that patterns tell."""
    symbols = symbols_of(code, language)
    return symbol_abstract(code, symbols["parameters"], symbols["types"], symbols["locals"])


def _numbered(name: str) -> bool:
    """renameable() of a plain value."""
    return re.fullmatch(NAME, name) is not None and name not in OWN_NAMES


def numbered_words(flat: str) -> str:
    """indexed_rename() of a plain text without comments."""
    parts, rank = re.findall(r"\w+|\W+", flat), {}
    for part in parts:
        if part not in rank and _numbered(part):
            rank[part] = len(rank) + 1
    last = {}
    for name, at in rank.items():
        to = f"a{at}"
        while (after := rank.get(to, 0)) > at:
            at, to = after, f"a{after}"
        last[name] = to
    return "".join([last.get(part, part) for part in parts])


def indexed_rename(code: Column) -> Column:
    """Names in the order of their first appearance become a1, a2, ... in turn, so that a name like a1 may be renamed
    again. Whole words are replaced, and stay whole, so each word's end can be told from the names' ranks alone."""
    return by_text(numbered_words)(comments_to_blanks(code))


def rename_tokens(code: Column) -> Column:
    """Names are replaced where they stand, all at once; literals are left alone."""

    def of(every) -> str:
        rank: dict[str, str] = {}
        for t in every:
            if t not in rank and _numbered(t):
                rank[t] = f"a{len(rank) + 1}"
        return "".join([rank.get(t, t) for t in every])

    return by_text(of)(tokens(code))


def mapped_lines(original: str, abstracted: str) -> list[tuple[str, str]]:
    """(line, abst): lines side by side up to the shorter text: the stripped line without comments, and the stripped abstracted
    line. Lines without anything else go."""
    pairs = ((bare(a.strip()), b.strip()) for a, b in zip(original.split("\n"), abstracted.split("\n")))
    return [(line, abst) for line, abst in pairs if line.strip()]


def abstracted_lines(own: list[str], mapped: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(norm, abst) of normalised lines; mapped is of mapped_lines(). The first line of the code that is the given one when
    normalised counts, and of equal lines the last one's abstraction; a line that is not there is its own."""
    first, last = {}, dict(mapped)
    for key, _ in mapped:
        first.setdefault(normal(key), key)
    return [(x, normal(last[first[x]]) if x in first else x) for x in own]


def line_map(original: Column, abstracted: Column) -> Column:
    """mapped_lines() as array<struct<line, abst>>."""
    return by_text(mapped_lines, "array<struct<line:string,abst:string>>")(original, abstracted)


def with_abstraction(lines: Column, mapped: Column) -> Column:
    """abstracted_lines() as array<struct<norm, abst>>; mapped is line_map()."""
    return by_text(abstracted_lines, "array<struct<norm:string,abst:string>>")(lines, mapped)
