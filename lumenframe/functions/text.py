"""String functions as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit


def memformat(n: Column) -> Column:
    """Bytes with a unit: 1.0 KB, 3.5 MB."""
    unit = lambda k, name: F.format_string(f"%.1f {name}", n / float(1 << k))
    return F.when(n >= 1 << 30, unit(30, "GB")).when(n >= 1 << 20, unit(20, "MB")).when(n >= 1 << 10, unit(10, "KB")).otherwise(F.concat(n.cast("long").cast("string"), lit(" B")))


def timeintervalformat(s: Column, digits: int = 1) -> Column:
    """Seconds as days, hours, minutes and seconds, from the first one that is not zero."""
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    rest = s % 60
    tail = F.format_string(f"%.{digits}fs", rest)
    return (
        F.when(d > 0, F.format_string(f"%dd %dh %dm %.{digits}fs", d, h, m, rest)).when(h > 0, F.format_string(f"%dh %dm %.{digits}fs", h, m, rest)).when(m > 0, F.format_string(f"%dm %.{digits}fs", m, rest)).otherwise(tail)
    )


def escape_chars(s: Column) -> Column:
    out = F.replace(s, lit("\\"), lit("\\\\"))
    for c, e in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ('"', '\\"')):
        out = F.replace(out, lit(c), lit(e))
    return out


def unescape_chars(s: Column) -> Column:
    out = F.replace(s, lit("\\\\"), lit("\0"))
    for c, e in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ('"', '\\"')):
        out = F.replace(out, lit(e), lit(c))
    return F.replace(out, lit("\0"), lit("\\"))


def iequals(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def iless(a: Column, b: Column) -> Column:
    return F.lower(a) < F.lower(b)


def starts_with(a: Column, b: Column) -> Column:
    return F.startswith(a, b)


def istarts_with(a: Column, b: Column) -> Column:
    return F.startswith(F.lower(a), F.lower(b))


def ends_with(a: Column, b: Column) -> Column:
    return F.endswith(a, b)


def iends_with(a: Column, b: Column) -> Column:
    return F.endswith(F.lower(a), F.lower(b))


def find(a: Column, b: Column) -> Column:
    """Index of the first occurrence from 0; -1 if there is none."""
    return F.position(b, a) - 1


def ifind(a: Column, b: Column) -> Column:
    return find(F.lower(a), F.lower(b))


def rfind(a: Column, b: Column) -> Column:
    at = F.position(F.reverse(b), F.reverse(a))
    return F.when(at == 0, -1).otherwise(F.length(a) - at - F.length(b) + 1)


def irfind(a: Column, b: Column) -> Column:
    return rfind(F.lower(a), F.lower(b))


def contains(a: Column, b: Column) -> Column:
    return F.contains(a, b)


def icontains(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def contains_any_char(a: Column, chars: str) -> Column:
    return F.translate(a, chars, "") != a


def strip(a: Column, chars: str = " \t\n\r\f\v") -> Column:
    return F.btrim(a, lit(chars))


def lstrip(a: Column, chars: str = " \t\n\r\f\v") -> Column:
    return F.ltrim(a, lit(chars))


def rstrip(a: Column, chars: str = " \t\n\r\f\v") -> Column:
    return F.rtrim(a, lit(chars))


def split(a: Column, sep: str, maxsplit: int = -1) -> Column:
    """At a literal separator, at most maxsplit times."""
    return F.split(a, f"\\Q{sep}\\E", maxsplit + 1 if maxsplit >= 0 else -1)


def stoi(a: Column) -> Column:
    """The integer that the string begins with; 0 if it does not."""
    return F.coalesce(F.regexp_extract(a, r"^\s*([+-]?\d{1,9})", 1).try_cast("int"), lit(0))


def stof(a: Column) -> Column:
    return F.coalesce(F.regexp_extract(a, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double"), lit(0.0))


def string_is_int(a: Column) -> Column:
    return a.rlike(r"^\s*[+-]?\d+\s*$")


def string_is_float(a: Column) -> Column:
    return a.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def parse_word(a: Column) -> Column:
    return F.regexp_extract(a, r"^\s*([A-Za-z]+)", 1)


def parse_identifier(a: Column) -> Column:
    return F.regexp_extract(a, r"^\s*([A-Za-z_][A-Za-z0-9_]*)", 1)


def parse_until(a: Column, chars: str) -> Column:
    return F.regexp_extract(a, f"^([^{chars}]*)", 1)


def parse_while(a: Column, chars: str) -> Column:
    return F.regexp_extract(a, f"^([{chars}]*)", 1)


def parse_line(a: Column) -> Column:
    return F.substring_index(a, "\n", 1)


def wordwrap(a: Column, columns: int) -> Column:
    """Lines of at most `columns` characters, broken at blanks."""
    step = lambda acc, w: F.when(F.length(acc) == 0, w).when(F.length(F.substring_index(acc, "\n", -1)) + F.length(w) + 1 > columns, F.concat(acc, lit("\n"), w)).otherwise(F.concat(acc, lit(" "), w))
    return F.aggregate(F.split(a, " "), lit(""), step)


def utf8_to_unicode(s: Column) -> Column:
    """The code points of all characters."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _rest(s: Column, found: Column, after: Column) -> Column:
    """found, and the text after what was eaten; the whole text if nothing was."""
    return F.struct(found.alias("found"), F.when(found, after).otherwise(s).alias("rest"))


def parse_char(s: Column, c: str, skip_whitespace: bool = True) -> Column:
    """Whether the text begins with a character, after blanks if they are skipped; and what follows."""
    body = F.ltrim(s) if skip_whitespace else s
    return _rest(s, F.startswith(body, lit(c)), F.substr(body, lit(2)))


def parse_prefix(s: Column, prefix: str, skip_whitespace: bool = True) -> Column:
    """Whether the text begins with prefix; and what follows."""
    body = F.ltrim(s) if skip_whitespace else s
    return _rest(s, F.startswith(body, lit(prefix)), F.substr(body, lit(len(prefix) + 1)))


def _parsed(s: Column, pattern: str, kind: str) -> Column:
    text = F.regexp_extract(s, rf"^\s*({pattern})", 1)
    size = F.char_length(F.regexp_extract(s, rf"^(\s*{pattern})", 1))
    return F.struct(F.when(text != "", text.cast(kind)).alias("value"), F.substr(s, size + 1).alias("rest"))


def parse_int(s: Column) -> Column:
    """The whole number that the text begins with, after blanks, or null; and what follows."""
    return _parsed(s, "[-+]?[0-9]+", "int")


def parse_float(s: Column) -> Column:
    return _parsed(s, r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", "double")


def stod(s: Column) -> Column:
    """The number that the text begins with, 0 if none."""
    return F.coalesce(parse_float(s)["value"], lit(0.0))


def parse_string(s: Column, keep_quotes: bool = False) -> Column:
    """The quoted string, or else the run without blanks, that the text begins with; and what follows."""
    quoted = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
    text = F.regexp_extract(s, rf"^\s*({quoted}|[^\s\"']+)", 1)
    size = F.char_length(F.regexp_extract(s, rf"^(\s*(?:{quoted}|[^\s\"']+))", 1))
    bare = F.when(text.rlike("^[\"']"), F.substr(text, lit(2), F.greatest(F.char_length(text) - 2, lit(0)))).otherwise(text)
    return F.struct((text if keep_quotes else bare).alias("value"), F.substr(s, size + 1).alias("rest"))


def parse_nested(s: Column) -> Column:
    """The balanced part in (), [] or {} that the text begins with, or an empty one; and what follows."""
    opening = F.substr(s, lit(1), lit(1))
    closing = F.translate(opening, "([{", ")]}")
    step = lambda acc, c: F.struct(
        F.when(acc["end"] > 0, acc["depth"]).when(c == opening, acc["depth"] + 1).when(c == closing, acc["depth"] - 1).otherwise(acc["depth"]).alias("depth"),
        (acc["at"] + 1).alias("at"),
        F.when(acc["end"] > 0, acc["end"]).when((c == closing) & (acc["depth"] == 1), acc["at"] + 1).otherwise(0).alias("end"),
    )
    start = F.struct(lit(0).alias("depth"), lit(0).alias("at"), lit(0).alias("end"))
    end = F.when(opening.isin("(", "[", "{"), F.aggregate(F.split(s, ""), start, step, lambda acc: acc["end"])).otherwise(0)
    return F.struct(F.substr(s, lit(1), end).alias("value"), F.substr(s, end + 1).alias("rest"))
