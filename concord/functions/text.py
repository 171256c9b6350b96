"""Text and item functions, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from concord.functions import vocab


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (trim() takes blanks alone)."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), r"(?U)\s+", " ")


def is_missing(c: Column | str, words: tuple[str, ...]) -> Column:
    """Whether the text is null or, stripped and in lower case, one of the words; never null."""
    c = as_column(c).cast("string")
    return c.isNull() | F.lower(strip(c)).isin(*words)


def item_name(item: Column | str, theme: str | None = None) -> Column:
    """Blanks for underscores and one blank between words; missing items are empty.

    With a theme that begins with "wild" a suffix _none or _mixed would go too, but
    no underscore is left by then, so the theme changes nothing.
    """
    return F.when(is_missing(item, vocab.MISSING_NUMERIC), "").otherwise(strip(squeeze(F.translate(strip(item), "_", " "))))


def item_base(item: Column | str) -> Column:
    """item_name without a last word none or mixed."""
    return strip(F.regexp_replace(item_name(item), r"(?i)\s+(none|mixed)\s*$", ""))


def singular(token: Column) -> Column:
    return F.when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.left(token, F.length(token) - 1)).otherwise(token)


def item_key(item: Column | str, merge_none_mixed: bool = True) -> Column:
    """One key for spellings, cases, blanks and simple plurals of an item."""
    low = F.lower(item_name(item))
    if merge_none_mixed:
        low = F.regexp_replace(low, r"\s+(none|mixed)\s*$", "")
    spelled = F.create_map(*[F.lit(x) for pair in vocab.SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(F.split(low, " "), lambda t: singular(F.coalesce(F.try_element_at(spelled, t), t))), "")


def text_key(text: Column | str) -> Column:
    """A place or species as its sorted words.

    Outer square brackets and quotes and anything in parentheses go, then all but
    a-z, 0-9 and hyphens, then stop words unless nothing else is left; repeated words
    stay.
    """
    c = as_column(text)
    c = F.when(c.rlike(r"(?s)^\[.*\]$"), F.regexp_replace(c, r"(?s)^\[|\]$", "")).otherwise(c)
    c = F.regexp_replace(c, "^[ '\"]+|[ '\"]+$", "")
    c = F.lower(F.regexp_replace(c, r"\([^)]*\)|/", " "))
    words = F.filter(F.split(F.regexp_replace(c, r"[^a-z0-9\-]+", " "), " "), lambda t: t != "")
    kept = F.filter(words, lambda t: ~t.isin(*vocab.STOPWORDS))
    return F.coalesce(F.array_join(F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(words)), " "), F.lit(""))


def item_kind(item: Column | str) -> Column:
    """period, coord or text, by the item's name."""
    low = F.lower(strip(F.coalesce(as_column(item), F.lit(""))))
    return F.when(low.contains("period"), "period").when(low.contains("longitude") | low.contains("latitude") | low.isin("lon", "lat"), "coord").otherwise("text")


def without_tags(text: Column | str) -> Column:
    """Without control characters, then without anything between < and >."""
    return F.regexp_replace(F.regexp_replace(as_column(text), r"[\x00-\x1F\x7F]", ""), "<.*?>", "")


def model_name(model: Column | str) -> Column:
    return F.element_at(F.split(as_column(model), "/"), -1)


def paper_id(value: Column | str) -> Column:
    """Stripped, without .0 behind digits, digits alone with at least two; null where missing or empty."""
    text = F.regexp_replace(strip(as_column(value).cast("string")), r"^(\d+)\.0$", "$1")
    return F.when(text == "", F.lit(None)).when(text.rlike(r"^\d$"), F.concat(F.lit("0"), text)).otherwise(text)


def paper_prefix(path: Column | str) -> Column:
    """The numeric head of a file's stem before _ or -, of at least two digits; else the stem."""
    stem = F.regexp_replace(F.regexp_extract(as_column(path), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    head = F.regexp_extract(stem, r"^([^_-]*)", 1)
    return F.when(head.rlike(r"^\d+$"), paper_id(head)).otherwise(stem)


def joined_distinct(values: Column, separator: str) -> Column:
    """Aggregate: the sorted distinct values that aren't empty, joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(values != "", values))), separator)


def endpoint(url: Column | str) -> Column:
    """Scheme and host in lower case, no slash at the end; null for other schemes and where it has credentials, a query or a fragment."""
    c = strip(url)
    parts = F.regexp_extract(c, r"^(?i)(https?://[^/?#@]+)((?:/[^?#]*)?)$", 1)
    return F.when(parts == "", F.lit(None)).otherwise(F.regexp_replace(F.concat(F.lower(parts), F.regexp_extract(c, r"^(?i)(https?://[^/?#@]+)((?:/[^?#]*)?)$", 2)), "/+$", ""))


def messages(system: Column | str, context: Column | str, question: Column | str) -> Column:
    """Three messages of a request: instructions, the paper and the question."""
    said = [F.struct(F.lit(role).alias("role"), as_column(c).alias("content")) for role, c in (("system", system), ("user", context), ("user", question))]
    return F.array(*said)


def fill(template: Column | str, **values: Column | str) -> Column:
    """The template with each {name} replaced by its value, in one go each, names in order."""
    c = as_column(template)
    for name, value in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), F.coalesce(as_column(value).cast("string"), F.lit("")))
    return c


def file_token(text: Column | str) -> Column:
    """A portable file name: unsafe characters as _, at most 100; twelve digits of a digest behind it wherever that changed anything."""
    c = as_column(text)
    safe = F.left(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", ""), F.lit(100))
    reserved = F.lower(safe).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    digest = F.left(F.sha2(quoted, 256), F.lit(12))
    return F.when((safe != "") & safe.eqNullSafe(c) & ~reserved, safe).otherwise(F.concat(F.when(safe == "", "model").otherwise(safe), F.lit("-"), digest))
