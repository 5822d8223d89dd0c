"""Fields that pack several values into one string: one row per value, position kept.

The grammar, with ordered alternatives (the first that matches wins, else the parser backtracks):

    field   <- gap* (value (gap+ value)*)? gap* !.
    value   <- quoted / plain
    quoted  <- '"' ('""' / !'"' .)* '"' &end  /  "'" ("''" / !"'" .)* "'" &end
    plain   <- (bracket / !gap .)+ (space+ bracket &end)?
    bracket <- '(' (bracket / !')' .)* ')'  /  '[' (bracket / !']' .)* ']'
    gap     <- [;,|/+&] / space
    end     <- space* ([;,|/+&] / !.)  /  space+

A quote that never closes, or closes inside a word, makes ``quoted`` fail; the value is then read again as
``plain`` and flagged. An opening bracket without its end is read as an ordinary character and flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_TYPE = T.ArrayType(
    T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("value", "kind", "flag")]])
)

_GAP = re.compile(r"[;,|/+&\s]*")
_END = re.compile(r"\s*(?:[;,|/+&]|\Z)|\s+")
_RUN = re.compile(r"[^;,|/+&\s()\[\]]+")
_SPACE = re.compile(r"\s+")
#: Marks that part values and stand in no remark, so that "NA; A" is two values.
_PARTED = re.compile(r"[;|+&]")
_QUOTED = {'"': re.compile(r'"((?:[^"]|"")*+)"'), "'": re.compile(r"'((?:[^']|'')*+)'")}
_CLOSE = {"(": ")", "[": "]"}

#: Words a remark is made of when a field says that there is no value (fixed values).
REMARK = re.compile(
    r"(?:not|no|none|nil|null|nan|na|n|a|see|parent|pending|ask|curator|assigned|available|applicable|unassigned|"
    r"unknown|missing|empty|unmapped|found|id|ids|entry|tbd|tbc|to|be|done|checked|check|record|value|is|of|the|later|mapped|yet)",
    re.I,
)


def _bracket(text: str, i: int) -> int:
    """End of the bracket that opens at i, or -1."""
    want = [_CLOSE[text[i]]]
    for j in range(i + 1, len(text)):
        c = text[j]
        if c in _CLOSE:
            want.append(_CLOSE[c])
        elif c == want[-1]:
            want.pop()
            if not want:
                return j + 1
    return -1


def _plain(text: str, i: int) -> tuple[int, str, str | None]:
    """A bare value with any brackets it holds: end, kind, flag."""
    kind, flag, n, j = "bare", None, len(text), i
    while j < n:
        c = text[j]
        if c in _CLOSE:
            end = _bracket(text, j)
            if end < 0:
                flag, j = "unclosed_bracket", j + 1
            else:
                kind, j = "bracketed", end
        elif m := _RUN.match(text, j):
            j = m.end()
        elif c in ")]":
            flag, j = "stray_bracket", j + 1
        elif kind == "bare" and (m := _SPACE.match(text, j)) and m.end() < n and text[m.end()] in _CLOSE:
            end = _bracket(text, m.end())
            if end < 0 or not _END.match(text, end):
                break
            return end, "bracketed", flag
        else:
            break
    return j, kind, flag


def parse_packed(text: str | None) -> list[tuple[int, str, str, str | None]]:
    """(pos, value, kind, flag) of each value in the field, positions from 1; a null field has none."""
    out: list[tuple[int, str, str, str | None]] = []
    if not text:
        return out
    i, n = _GAP.match(text).end(), len(text)
    while i < n:
        c, flag, value = text[i], None, None
        if c in _QUOTED:
            m = _QUOTED[c].match(text, i)
            if m and _END.match(text, m.end()):
                i, value, kind = m.end(), m[1].replace(c + c, c).strip(), "quoted"
            else:
                flag = "malformed_quote"
        if value is None:
            end, kind, other = _plain(text, i)
            value, i, flag = text[i:end].strip(), max(end, i + 1), flag or other
        if value:
            out.append((len(out) + 1, value, kind, flag))
        i = _GAP.match(text, i).end()
    return out


def is_remark(values: list[str]) -> bool:
    """Whether the values together say only that there is none: every letter run is a word of a remark."""
    return all(REMARK.fullmatch(w) for v in values for w in re.findall(r"[^\W_]+", v))


@F.pandas_udf(VALUE_TYPE)
def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        rows = []
        for text in texts:
            parsed = parse_packed(text)
            rows.append([] if parsed and is_remark([p[1] for p in parsed]) and not _PARTED.search(text) else parsed)
        yield pd.Series([[{"pos": p, "value": v, "kind": k, "flag": f} for p, v, k, f in r] for r in rows], dtype=object)


def split_packed(df: DataFrame, key: str, fields: list[str], value_name: str = "value") -> DataFrame:
    """One row per value of each packed field: key, field_name, pos, value, kind, flag, n_values.

    Null, blank and remark-only fields give no row; repeated values are kept; rows that are copies of another
    count once. Parsing is a map over rows: the only shuffle is the one that removes copies, on the three columns.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("packed")) for c in fields]))
    cells = df.select(F.col(key), named.alias("f")).select(key, "f.field_name", "f.packed").where(F.trim("packed") != "")
    parsed = cells.distinct().withColumn("v", _parse("packed"))
    return parsed.select(key, "field_name", F.size("v").alias("n_values"), F.explode("v").alias("v")).select(
        key, "field_name", F.col("v.pos").alias("pos"), F.col("v.value").alias(value_name), F.col("v.kind").alias("kind"), F.col("v.flag").alias("flag"), "n_values"
    )
