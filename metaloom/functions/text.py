"""Scalar text expressions (all JVM-side columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
CJK_EXT = "㐀-鿿"


def normalize(c: Column) -> Column:
    """Identity form: lower case without blanks, underscores, dashes, colons, slashes, brackets."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"[\s_\-:/（）()]+", "")


def fold(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def binding_key(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", "")


def registry_key(c: Column) -> Column:
    """Lower case with runs of blanks made one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"[\s_]+", "-")
    s = F.regexp_replace(s, f"[^a-z0-9{CJK}-]+", "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def tokens(c: Column) -> Column:
    """Words of [a-z0-9_] and two-character windows over Chinese runs."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(f"[a-z0-9_]+|[{CJK}]+"), F.lit(0))
    return F.when(low.rlike(f"[{CJK}]{{2}}"), F.flatten(F.transform(runs, _windows))).otherwise(runs)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(tokens: Column) -> Column:
    """Array of (token, tf) of an array of tokens: sorted, then cut where a token differs from the one before; linear in its length."""

    def runs(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        ends = lambda first, k: F.coalesce(F.get(first, k + 1), F.size(ordered))
        return let(starts, lambda first: F.transform(first, lambda i, k: F.struct(F.get(ordered, i).alias("token"), (ends(first, k) - i).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<token:string,tf:bigint>>"))


def _windows(x: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.when(x.rlike(f"^[{CJK}]{{2,}}$"), grams).otherwise(F.array(x))


def terms(c: Column) -> Column:
    """Distinct latin words of two or more letters plus Chinese two-character windows."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK_EXT}]{{2,}}"), F.lit(0))
    grams = F.flatten(
        F.transform(runs, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))
    )
    return F.array_distinct(F.when(low.rlike(f"[{CJK_EXT}]{{2}}"), F.concat(latin, grams)).otherwise(latin))


def split_values(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), "[,;，；\n|]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def token_estimate(c: Column) -> Column:
    """Budget guard: one per Chinese character, one per four other non-blank characters, at least one."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    cjk = F.regexp_count(text, F.lit(f"[{CJK_EXT}]"))
    other = F.length(F.regexp_replace(text, rf"[{CJK_EXT}\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]", ""))
    return F.greatest(F.lit(1), cjk + F.ceil(other / 4.0)).cast("long")


def billing_estimate(c: Column) -> Column:
    """Report-side estimate: blanks count, wider Chinese ranges, empty text is zero."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    wide = "[㐀-䶿一-鿿豈-﫿]"
    cjk = F.regexp_count(text, F.lit(wide))
    return (cjk + F.floor((F.length(text) - cjk + 3) / 4)).cast("long")


def catalog_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"[\s_-]+", "")


def catalog_tokens(c: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[\s,，。;；/\\|_-]+")
    return F.filter(parts, lambda x: x != "")


def fact_key(c: Column) -> Column:
    return F.regexp_replace(
        F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"[\s_\-–—/\\|:：()（）\[\]【】]+", ""
    )


def fact_tokens(c: Column) -> Column:
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    latin = F.filter(F.split(low, r"[^a-z0-9_.-]+"), lambda x: F.length(x) >= 2)
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    grams = F.flatten(
        F.transform(
            runs,
            lambda x: F.when(F.length(x) <= 4, F.array(x)).otherwise(
                F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))
            ),
        )
    )
    return F.array_distinct(F.when(low.rlike(f"[{CJK}]{{2}}"), F.concat(latin, grams)).otherwise(latin))


def overlap_terms(c: Column) -> Column:
    """Distinct terms of three or more characters used by the similarity linker."""
    low = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "s1mme", "s1-mme")
    words = F.transform(F.split(low, f"[^a-z0-9{CJK}-]+"), fact_key)
    joined = F.transform(F.regexp_extract_all(low, F.lit("[a-z0-9]+(?:[/-][a-z0-9]+)+"), F.lit(0)), fact_key)
    return F.array_distinct(F.filter(F.concat(words, joined), lambda x: F.length(x) >= 3))


def bracket_terms(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def percent_encode(c: Column) -> Column:
    """Path-segment encoding: blanks become %20 and the tilde stays."""
    encoded = F.url_encode(c.cast("string"))
    return F.replace(F.replace(F.replace(encoded, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pair_key(*cols: Column) -> Column:
    """Parts joined by the unit separator, for stable ids."""
    return F.concat_ws("\u001f", *cols)


def short_hash(c: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)
