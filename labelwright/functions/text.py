"""Scalar text functions as column expressions; folding of Unicode goes over distinct values only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stripping removes, 29 code points of which Spark's trim by itself knows one.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: Words that stand for an absent value, and for true.
ABSENT = ("none", "no", "n/a", "unknown")
TRUE = ("1", "true", "yes", "on")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def dict_key(c: Column) -> Column:
    """The key under which the dictionary knows a raw label: stripped, lower case, without trailing commas; inner white space stays."""
    return F.rtrim(F.lower(strip(c)), F.lit(","))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def present(c: Column) -> Column:
    """Whether free text names something: not blank and none of ``ABSENT``."""
    t = F.lower(strip(c))
    return F.coalesce((t != "") & ~t.isin(*ABSENT), F.lit(False))


def lenient_date(c: Column) -> Column:
    """The date of an ISO date or timestamp; null if it is none."""
    return F.try_to_date(F.split_part(c, F.lit("T"), F.lit(1)), "yyyy-MM-dd")


def slash_parts(c: Column) -> Column:
    """Stripped, non-blank parts between slashes."""
    return F.filter(F.transform(F.split(c, "/"), strip), lambda x: x != "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def axis_prefix(c: Column) -> Column:
    """What stands before the first ": ", with it; null without one."""
    at = F.instr(c, ": ")
    return F.when(at > 0, F.substring(c, F.lit(1), at + 1))


def id_set(ids: Column) -> Column:
    """Ids as text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(ids, lambda x: x.cast("string"))))


def loose_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*TRUE), F.lit(False))


def positive_int(c: Column, default: int) -> Column:
    n = c.cast("string").try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))


def text_list(c: Column) -> Column:
    """A JSON array of strings or comma-separated text as an array without blanks."""
    parsed = F.when(strip(c).startswith("["), F.from_json(c, "array<string>"))
    return F.filter(F.transform(F.coalesce(parsed, F.split(c, ",")), strip), lambda x: x != "")


def pointer_part(c: Column) -> Column:
    """A key as part of a JSON Pointer."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def status_code(message: Column) -> Column:
    """The first three-digit number of an error text, as text; empty without one."""
    return F.regexp_extract(message, r"\b(\d{3})\b", 1)


def not_expired(expires_at: Column, now: Column) -> Column:
    """Whether an ISO time (UTC if it names no zone) is later than now; what cannot be read has expired."""
    return F.coalesce(F.try_to_timestamp(expires_at) > now, F.lit(False))


def reason_lists(text: Column) -> Column:
    """Ownership reasons of JSON text as four arrays of non-empty names; null if all are empty or the text cannot be read."""
    kinds = ("added", "removed_managed", "preserved_external", "preserved_protected")
    read = F.from_json(text, "struct<" + ",".join(f"{k}:array<string>" for k in kinds) + ">")
    lists = {k: F.filter(F.coalesce(read[k], F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")) for k in kinds}
    some = F.lit(0)
    for c in lists.values():
        some = some + F.size(c)
    return F.when(some > 0, F.struct(*(c.alias(k) for k, c in lists.items())))


def scope_name(text: Column) -> Column:
    """The scope of JSON text: a string, or the string under ``name`` of an object; else null."""
    plain = F.when(strip(text).startswith('"'), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]"))
    return F.coalesce(plain, F.when(strip(text).startswith("{"), F.get_json_object(text, "$.name")))


def joined_notes(notes: Column) -> Column:
    """A list of notes as one text; empty notes are left out."""
    return F.array_join(F.filter(notes, lambda x: x.isNotNull() & (x != "")), "; ")


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def qualified(label: Column, word: Column) -> Column:
    return F.concat(label, F.lit(" ("), word, F.lit(")"))


#: Typographic dashes, quotes and the low comma with their plain forms, and what is cut from both ends of a label.
PLAIN_FORMS = {
    "-": "\u00ad\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d",
    "'": "\u2018\u2019\u201b\u2032",
    '"': "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb",
    ",": "\u201a",
}
LABEL_EDGES = " \t\n\r\v\f\"'"
_TO_PLAIN = str.maketrans({c: plain for plain, odd in PLAIN_FORMS.items() for c in odd})


def _tidy(text: str) -> str:
    text = re.sub(r"\s+", " ", text.translate(_TO_PLAIN)).strip(LABEL_EDGES)
    return re.sub("--+", "-", text.rstrip(".,").strip(LABEL_EDGES))


def fold_label(text: str) -> str:
    """The key of the alias tables: compatibility forms, folded case, plain quotes and dashes, single blanks, no trailing marks."""
    return _tidy(unicodedata.normalize("NFKC", text).casefold())


def fold_label_keep_case(text: str) -> str:
    return _tidy(unicodedata.normalize("NFKC", text))


def fold_name(text: str) -> str:
    """The key of entity names."""
    return unicodedata.normalize("NFC", text.strip()).casefold()


#: The dotless i, which stays itself, and a private character that stands for it meanwhile.
_DOTLESS, _STAND_IN = "\u0131", "\ue0d1"


def fold_case(c: Column) -> Column:
    """Text under which names that differ in case alone are equal, sharp s and ligatures included; no UDF.

    The upper case of the lower case writes such letters out; its lower case is then the same for all spellings.  A final
    sigma is a sigma, and the dotless i keeps apart from the dotted one.  Of ASCII text that is its lower case, without
    the replacing of letters, which costs most of the time.
    """
    upper = F.translate(F.upper(F.translate(F.lower(c), _DOTLESS, _STAND_IN)), _STAND_IN, _DOTLESS)
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(F.lower(upper), "\u03c2", "\u03c3"))


def with_folded(df: DataFrame, column: str, to: str, fold: Callable[[str], str]) -> DataFrame:
    """``df`` with column ``to``, the folded text: plain ASCII letters and digits by built-in functions, the rest by a
    pandas UDF over its distinct values, joined back.  Null stays null."""
    simple = F.col(column).rlike("^[A-Za-z0-9:]+( [A-Za-z0-9:]+)*$")
    cased = F.lower(column) if fold is not fold_label_keep_case else F.col(column)

    @F.pandas_udf("string")
    def folded(values):  # noqa: ANN001, ANN202
        return values.map(fold)

    odd = df.where(F.col(column).isNotNull() & ~simple).select(F.col(column).alias("_odd")).distinct().withColumn("_folded", folded("_odd"))
    out = df.join(odd, F.col(column) == F.col("_odd"), "left")
    return out.withColumn(to, F.when(simple, cased).otherwise(F.col("_folded"))).drop("_odd", "_folded")
