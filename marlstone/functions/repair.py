"""What isn't regular in model output: balanced objects, cut-off code, Markdown blocks. Plain functions, and Arrow functions of columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str | None) -> str | None:
    """The first balanced {...}, minding strings and escapes."""
    depth, start, quoted, escaped = 0, None, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def code_of(text: str | None) -> str | None:
    """Code in a JSON object's field `code`, in a fenced block, or in an object that was cut off."""
    if not (text or "").strip():
        return None
    try:
        x = json.loads(text)
        if isinstance(x, dict) and isinstance(x.get("code"), str):
            return x["code"]
    except ValueError:
        pass
    if m := re.search(r"```(?:python|py)?\s*\n(.*?)(?:```|\Z)", text, re.S):
        return m.group(1).strip()
    if m := re.search(r'"code"\s*:\s*"(.*)', text, re.S):
        out, rest = [], m.group(1)
        i = 0
        while i < len(rest):
            if rest[i] == "\\" and i + 1 < len(rest):
                out.append({"n": "\n", "t": "\t", "r": "\r"}.get(rest[i + 1], rest[i + 1]))
                i += 2
            elif rest[i] == '"':
                break
            else:
                out.append(rest[i])
                i += 1
        return "".join(out).strip() or None
    return None


def flex_blocks(text: str | None) -> dict[str, dict[str, str]]:
    """Blocks of the three levels, each with title, summary and content; a level that isn't there has empty ones."""
    out = {}
    for level in ("strategy", "pattern", "case"):
        m = re.search(rf"(?ims)^#\s*{level}\b.*?$(.*?)(?=^#\s|\Z)", text or "")
        block = m.group(1) if m else ""
        out[level] = {k: (s.group(1).strip() if (s := re.search(rf"(?ims)^##\s*{k}\s*:?[ \t]*\n?(.*?)(?=^##|\Z)", block)) else "") for k in ("title", "summary", "content")}
    return out


def scrub(text: str | None, most: int = 600) -> str:
    """A memory's text without fenced JSON and what names a market or a prediction."""
    t = re.sub(r"(?s)```(?:json)?.*?(```|\Z)", " ", text or "")
    t = re.sub(r"(?i)[\"']?(market_id|predicted_prob)[\"']?\s*[:=]\s*[\"']?[^\s,\"'}]+[\"']?", " ", t)
    return " ".join(t.split())[:most].strip(" ,;:-")


def truncate(text: str | None, tokens: int) -> str:
    """So many words, then dots; a shorter text as it is."""
    parts = re.findall(r"\S+\s*", text or "")
    return text or "" if len(parts) <= tokens else "".join(parts[:tokens]).rstrip() + "..."


def column(f: Callable[[str | None], str | None], x: Column) -> Column:
    """A function of texts over a column, in Arrow batches."""
    import pandas as pd

    def run(s):
        return pd.Series([f(None if v is None else v) for v in s], dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(x)
