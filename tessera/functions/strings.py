"""``Series.str``: string methods as Column expressions; a pandas UDF only where no expression has the meaning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXPRESSED = {}


def _method(f):
    EXPRESSED[f.__name__.rstrip("_")] = f
    return f


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def _class(chars: str) -> str:
    return "[" + re.sub(r"([\\\]\[^-])", r"\\\1", chars) + "]"


def elementwise(name: str, kind: str = "string"):
    """A method that runs vectorised in Python: ``Series.str.<name>`` on Arrow batches."""

    def apply(c: Column, *args, **kwargs) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return getattr(s.str, name)(*args, **kwargs)

        return run(c)

    return apply


for _name in ("casefold", "istitle", "normalize", "swapcase", "title", "wrap"):
    EXPRESSED[_name] = elementwise(_name, "boolean" if _name == "istitle" else "string")


@_method
def capitalize(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


@_method
def lower(c):
    return F.lower(c)


@_method
def upper(c):
    return F.upper(c)


@_method
def len_(c):
    return F.length(c)


def _padded(c, width, left, right, fill):
    need = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    if left and right:
        # an odd surplus goes left exactly when the width is odd too
        before = F.floor(need / 2) + (need.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1)))
        return F.concat(F.repeat(F.lit(fill), before.cast("int")), c, F.repeat(F.lit(fill), (need - before).cast("int")))
    pad = F.repeat(F.lit(fill), need.cast("int"))
    return F.concat(pad, c) if left else F.concat(c, pad)


@_method
def center(c, width, fillchar=" "):
    return _padded(c, width, True, True, fillchar)


@_method
def ljust(c, width, fillchar=" "):
    return _padded(c, width, False, True, fillchar)


@_method
def rjust(c, width, fillchar=" "):
    return _padded(c, width, True, False, fillchar)


@_method
def pad(c, width, side="left", fillchar=" "):
    return {"left": rjust, "right": ljust, "both": center}[side](c, width, fillchar)


@_method
def zfill(c, width):
    signed = c.rlike("^[+-]")
    body = F.when(signed, F.substring(c, 2, 1 << 30)).otherwise(c)
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(c), F.lit(0)).cast("int"))
    return F.concat(F.when(signed, F.substring(c, 1, 1)).otherwise(F.lit("")), zeros, body)


def _flags(pattern, case=True, flags=0):
    marks = ("i" if not case or flags & re.I else "") + ("m" if flags & re.M else "") + ("s" if flags & re.S else "")
    return (f"(?{marks})" if marks else "") + pattern


def _missing(result, c, na):
    return result if na is None else F.coalesce(result, F.lit(na))


@_method
def contains(c, pat, case=True, flags=0, na=None, regex=True):
    if not regex:
        found = F.contains(c if case else F.lower(c), F.lit(pat if case else pat.lower()))
    else:
        found = c.rlike(_flags(pat, case, flags))
    return _missing(found, c, na)


@_method
def match(c, pat, case=True, flags=0, na=None):
    return _missing(c.rlike(_flags(rf"\A(?:{pat})", case, flags)), c, na)


@_method
def fullmatch(c, pat, case=True, flags=0, na=None):
    return _missing(c.rlike(_flags(rf"\A(?:{pat})\z", case, flags)), c, na)


@_method
def startswith(c, pat, na=None):
    return _missing(F.startswith(c, F.lit(pat)), c, na)


@_method
def endswith(c, pat, na=None):
    return _missing(F.endswith(c, F.lit(pat)), c, na)


@_method
def count(c, pat, flags=0):
    return F.regexp_count(c, F.lit(_flags(pat, True, flags)))


@_method
def find(c, sub, start=0, end=None):
    if end is not None:
        c = F.substring(c, 1, end)
    return F.locate(sub, c, start + 1) - 1


@_method
def index(c, sub, start=0, end=None):
    at = find(c, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


@_method
def rfind(c, sub, start=0, end=None):
    part = F.substring(c, start + 1, (1 << 30) if end is None else end - start)
    at = F.locate(sub[::-1], F.reverse(part), 1)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(part) - at - len(sub) + 1 + start)


@_method
def rindex(c, sub, start=0, end=None):
    at = rfind(c, sub, start, end)
    return F.when(at < 0, F.raise_error(F.lit("substring not found")).cast("int")).otherwise(at)


@_method
def findall(c, pat, flags=0):
    return F.regexp_extract_all(c, F.lit(_flags(pat, True, flags)), F.lit(1 if re.compile(pat).groups else 0))


@_method
def get(c, i):
    at = F.when(F.length(c) >= (i + 1 if i >= 0 else -i), F.substring(c, i + 1 if i >= 0 else i, 1))
    return at


@_method
def slice_(c, start=None, stop=None, step=None):
    if step not in (None, 1) or (stop is not None and stop < 0) or (start is not None and start < 0 and stop is not None):
        return elementwise("slice")(c, start, stop, step)
    start = start or 0
    if start < 0:
        return F.when(F.length(c) <= -start, c).otherwise(F.substring(c, start, -start))
    return F.substring(c, start + 1, (1 << 30) if stop is None else max(stop - start, 0))


@_method
def slice_replace(c, start=None, stop=None, repl=None):
    return F.concat(slice_(c, 0, start or 0), F.lit(repl or ""), F.lit("") if stop is None else slice_(c, stop))


def _tests(name, pattern):
    EXPRESSED[name] = lambda c: c.rlike(pattern)


_tests("isalnum", r"\A[\p{L}\p{N}]+\z")
_tests("isalpha", r"\A\p{L}+\z")
_tests("isdecimal", r"\A\p{Nd}+\z")
_tests("isdigit", r"\A[\p{Nd}\u00B2\u00B3\u00B9\u2070\u2074-\u2079\u2080-\u2089]+\z")
_tests("isnumeric", r"\A\p{N}+\z")
_tests("isspace", r"\A[\s\p{Z}]+\z")


@_method
def islower(c):
    return (c == F.lower(c)) & (c != F.upper(c))


@_method
def isupper(c):
    return (c == F.upper(c)) & (c != F.lower(c))


def _strip(c, chars, left, right):
    within = r"[\s\p{Z}]" if chars is None else _class(chars)
    if left:
        c = F.regexp_replace(c, rf"\A{within}+", "")
    return F.regexp_replace(c, rf"{within}+\z", "") if right else c


@_method
def strip(c, to_strip=None):
    return _strip(c, to_strip, True, True)


@_method
def lstrip(c, to_strip=None):
    return _strip(c, to_strip, True, False)


@_method
def rstrip(c, to_strip=None):
    return _strip(c, to_strip, False, True)


@_method
def removeprefix(c, prefix):
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


@_method
def removesuffix(c, suffix):
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


@_method
def repeat(c, repeats):
    return F.repeat(c, repeats)


@_method
def replace(c, pat, repl, n=-1, case=True, flags=0, regex=False):
    if n >= 0 or callable(repl):
        return elementwise("replace")(c, pat, repl, n=n, case=None if case else False, regex=regex)
    if regex or not case:
        replacement = re.sub(r"\\(\d)", r"$\1", repl.replace("$", r"\$"))
        return F.regexp_replace(c, _flags(pat if regex else _quoted(pat), case, flags), replacement)
    return F.replace(c, F.lit(pat), F.lit(repl))


@_method
def translate(c, table):
    table = {(chr(k) if isinstance(k, int) else k): (chr(v) if isinstance(v, int) else v) for k, v in table.items()}
    if all(v is None or len(v) == 1 for v in table.values()):
        kept = {k: v for k, v in table.items() if v is not None}
        gone = [k for k, v in table.items() if v is None]
        return F.translate(c, "".join([*kept, *gone]), "".join(kept.values()))
    return elementwise("translate")(c, str.maketrans(table))


@_method
def join(c, sep):
    return F.when(c.isNotNull(), F.concat_ws(sep, F.split(c, "")))


@_method
def encode(c, encoding="utf-8", errors="strict"):
    return F.encode(c, encoding.upper())


@_method
def decode(c, encoding="utf-8", errors="strict"):
    return F.decode(c, encoding.upper())


@_method
def partition(c, sep=" "):
    at = F.instr(c, sep)
    missing = F.array(c, F.lit(""), F.lit(""))
    return F.when(at > 0, F.array(F.substring(c, F.lit(1), at - 1), F.lit(sep), F.substring(c, at + len(sep), F.length(c)))).when(c.isNotNull(), missing)


@_method
def rpartition(c, sep=" "):
    at = rfind(c, sep)
    missing = F.array(F.lit(""), F.lit(""), c)
    return F.when(at >= 0, F.array(F.substring(c, F.lit(1), at), F.lit(sep), F.substring(c, at + len(sep) + 1, F.length(c)))).when(c.isNotNull(), missing)


@_method
def split(c, pat=None, n=-1):
    if pat is None:
        c, pattern = _strip(c, None, True, True), r"[\s\p{Z}]+"
    else:
        pattern = pat if len(pat) > 1 else _quoted(pat)
    parts = F.split(c, pattern, n + 1 if n and n > 0 else -1)
    return parts if pat is not None else F.filter(parts, lambda x: x != "")


@_method
def rsplit(c, pat=None, n=-1):
    if not n or n < 0 or pat is None:
        return split(c, pat, n) if pat is not None and (not n or n < 0) else elementwise("rsplit", "array<string>")(c, pat, n=n)
    parts = F.split(c, _quoted(pat), -1)
    head = F.concat_ws(pat, F.slice(parts, F.lit(1), F.size(parts) - n))
    return F.when(F.size(parts) <= n + 1, parts).otherwise(F.concat(F.array(head), F.slice(parts, -n, n)))


@_method
def extract(c, pat, group, flags=0):
    pattern = _flags(pat, True, flags)
    found = F.regexp_extract(c, pattern, group)
    return F.when(c.rlike(pattern), found)


@_method
def cat(c, others, sep="", na_rep=None):
    parts = [c, *others]
    if na_rep is not None:
        parts = [F.coalesce(p, F.lit(na_rep)) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep or ""), p)
    return out
