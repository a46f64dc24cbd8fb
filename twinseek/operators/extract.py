"""Functions of source files. An approximation by braces; a parser can take its place as `find`."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^\\'\n])*'|"(?:\\.|[^\\"\n])*"|[{}();]""", re.S)
NAMED = re.compile(r"([A-Za-z_~][\w:~]*)\s*$")
NO_FUNCTION = frozenset("if for while switch catch return sizeof else do synchronized try".split())
ENCODINGS = ("utf-8", "cp949", "euc-kr")


def decode(content: bytes | None) -> str | None:
    """By the first encoding that fits; null if none does."""
    for name in ENCODINGS:
        try:
            return (content or b"").decode(name)
        except UnicodeDecodeError:
            continue
    return None


def functions_of(text: str) -> list[str]:
    """Every body in braces that follows a name and a parameter list, with that head; nested ones too, after the one around."""
    out, open_, start, depth, head = [], [], 0, 0, None
    last_close = None
    for m in TOKEN.finditer(text):
        t = m[0]
        if t == "(":
            if depth == 0:
                name = NAMED.search(text, start, m.start())
                head = name[1] if name and name[1] not in NO_FUNCTION else None
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
            last_close = m.end()
        elif t in ";{}" and depth == 0:
            if t == "{":
                between = text[last_close : m.start()] if last_close is not None and last_close >= start else None
                is_function = head is not None and between is not None and re.fullmatch(r"[\s\w,.:&*<>\-]*", between) is not None
                open_.append(start if is_function else None)
            elif t == "}" and open_:
                begun = open_.pop()
                if begun is not None:
                    out.append((begun, -m.end(), text[begun : m.end()].strip()))
            start, head, last_close = m.end(), None, None
    return [body for _, _, body in sorted(out)]


def functions(files: DataFrame, find: Callable[[str], list[str]] = functions_of) -> DataFrame:
    """(path, function) of binary files (path, content). Files in no known encoding yield nothing."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(path, f) for path, content in zip(batch["path"], batch["content"]) if (text := decode(content)) is not None for f in find(text)]
            yield pd.DataFrame(rows, columns=["path", "function"])

    return files.select("path", "content").mapInPandas(run, "path string, function string")


