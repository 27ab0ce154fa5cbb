"""Text functions, as column expressions. Regular expressions are Unicode-aware where words and spaces are meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URL segments that say nothing about a page (fixed values).
DULL_SEGMENTS = ("index", "page", "item", "view", "default", "home")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(c: Column | str) -> Column:
    """Trimmed stretches up to and with . ! or ?, or the end of a line; blank ones are dropped."""
    cut = F.regexp_extract_all(_col(c), F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def squeeze(c: Column) -> Column:
    """Outer white space gone, inner runs of it one blank."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def clean_prompt(c: Column | str) -> Column:
    """A leading Query: (any case) and spare white space go."""
    return squeeze(F.regexp_replace(_col(c), r"(?i)(?U)^\s*Query\s*:\s*", ""))


def normalize_query(c: Column | str) -> Column:
    return F.lower(clean_prompt(c))


def clean_code(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?i)(?U)^\s*Code\s*:\s*", ""), r"(?U)^\s+|\s+$", "")


def kind_of(c: Column | str) -> Column:
    """query, code or other, by prefix."""
    c = _col(c)
    return F.when(c.rlike(r"(?i)^\s*Query\s*:"), "query").when(c.rlike(r"(?i)^\s*Code\s*:"), "code").otherwise("other")


def normalize_docid(c: Column | str) -> Column:
    """[docid], lower case, whatever brackets it came with."""
    return F.concat(F.lit("["), F.lower(F.regexp_replace(_col(c), r"^[\[\]]+|[\[\]]+$", "")), F.lit("]"))


def ids(c: Column) -> Column:
    """An array of ids as distinct non-empty strings in the order they first come; null is empty."""
    return F.array_distinct(F.filter(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")))


def url_segments(url: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(url)), "^https?://", "")
    return F.filter(F.split(F.replace(bare, F.lit("-"), F.lit(" ")), "/"), lambda s: s != "")


def url_is_rich(segments: Column) -> Column:
    """More than half of the segments say something: no number, no dull word, more than two characters."""
    telling = F.filter(segments, lambda s: ~s.rlike(r"^\p{N}+$") & ~s.isin(*DULL_SEGMENTS) & (F.length(s) > 2))
    return F.size(telling) * 2 > F.size(segments)


def url_title(url: Column, title: Column) -> tuple[Column, Column]:
    """(the string a document goes by, what it was made of): a rich URL's path from its end and its host, else title
    and host, else the title, else nothing."""
    segments = url_segments(F.coalesce(url, F.lit("")))
    host = F.get(segments, F.lit(0))
    name = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    path = F.reverse(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))))
    rich = (F.size(segments) > 0) & url_is_rich(segments)
    made = F.when(rich, "url").when((name != "") & host.isNotNull(), "title_domain").when(name != "", "title").otherwise("skipped")
    text = F.when(made == "url", F.array_join(F.concat(path, F.array(host)), " ")).when(made == "title_domain", F.concat_ws(" ", name, host)).when(made == "title", name)
    return text, made


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^<]+?>", " "))


def strict_id(v: Column) -> Column:
    """A VARIANT id as a string: missing and null are empty, lists and objects are an error."""
    kind = F.schema_of_variant(v)
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(v.isNull() | F.is_variant_null(v), "").when(nested, F.raise_error(F.concat(F.lit("an id must be a scalar, not "), kind))).otherwise(F.variant_get(v, "$", "string"))


def lowered_title(c: Column | str) -> Column:
    """Lower case, with blanks around punctuation marks, as a subword round trip leaves a title."""
    return squeeze(F.regexp_replace(F.lower(_col(c)), r"([\p{P}\p{S}])", " $1 "))


def project_json(line: Column, names: dict[str, str]) -> tuple[Column, list[Column]]:
    """(whether a line of JSON is an object with all fields, its fields as strings under new names); names: old to new.
    A field that is there and null counts as there."""
    v = F.try_parse_json(line)
    got = [F.variant_get(v, f"$.{old}", "variant") for old in names]
    there = F.lit(True)
    for g in got:
        there = there & g.isNotNull()
    return there, [F.variant_get(v, f"$.{old}", "string").alias(new) for old, new in names.items()]
