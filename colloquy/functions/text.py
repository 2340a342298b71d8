"""Text expressions. All of them stay in the JVM; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What counts as a word and as white space.
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x1c-\x1f]"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Inside a higher-order function a plain expression is computed again for every
    element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space (``trim`` drops spaces only)."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Strip, and turn every run of white space into one space."""
    return F.regexp_replace(strip(text), rf"(?U){SPACE}+", " ")


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def has_words(text: Column) -> Column:
    return F.lower(text).rlike(WORD)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens; none when there are fewer tokens."""

    def runs(w: Column) -> Column:
        # Words are named one by one: cutting an array for every place is three times as dear.
        places = F.sequence(F.lit(0), F.size(w) - n)
        grams = F.transform(places, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(
            F.array().cast("array<string>")
        )

    return let(tokens, runs)


def shingles(tokens: Column, k: int = 5) -> Column:
    """Set of k-word shingles; a shorter text is one shingle, an empty one none."""
    return let(
        tokens,
        lambda w: F.when(
            F.size(w).between(1, k - 1), F.array(F.array_join(w, " "))
        ).otherwise(ngrams(w, k)),
    )


def jaccard(a: Column, b: Column) -> Column:
    """|A∩B| / |A∪B|; null (no match) when either side is empty."""
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)),
    )


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences: cut after . ! ? plus space, and at newlines."""
    cut = F.split(F.regexp_replace(text, r"(?U)([.!?])\s+", "$1\n"), "\n", -1)
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def iso(ts: Column) -> Column:
    """ISO-8601 UTC text; the fraction is printed only when there is one."""
    micros = F.unix_micros(ts) % 1_000_000
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(micros != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(whole, fraction, F.lit("Z"))


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def float_text(number: Column) -> Column:
    """Decimal text of an epoch float: one digit after the point at least, no exponent."""
    # The shortest text of a double may have an exponent; as a decimal it has none.
    decimal = number.cast("double").cast("string").cast("decimal(38,18)").cast("string")
    exact = F.regexp_replace(decimal, r"0+$", "")
    return F.when(exact.endswith("."), F.concat(exact, F.lit("0"))).otherwise(exact)


def preview(text: Column, length: int, mark: str) -> Column:
    """First ``length`` characters on one line, with a mark when more follows."""
    head = F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))
    return F.concat(head, F.when(F.length(text) > length, mark).otherwise(""))


def file_stem(name: Column) -> Column:
    base = F.element_at(F.split(name, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def title_case(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))),
        ),
        "",
    )
