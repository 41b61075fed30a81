"""Text normalisation and display strings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words kept upper case and words kept lower case in titles.
UPPER_WORDS = ("NW", "NE", "SW", "SE", "US", "KY", "I")
LOWER_WORDS = ("of", "the", "and", "at", "on")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: Column | str) -> Column:
    """Trimmed, runs of white space one space; null stays null."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def name_key(c: Column | str) -> Column:
    """Lower case, runs of white space one space, null empty: equal keys mean equal names."""
    return F.lower(norm_text(F.coalesce(col(c), F.lit(""))))


def title_case(c: Column | str) -> Column:
    """Words capitalised, but for those that stay upper case, and lower-case ones that aren't first."""

    def word(w: Column, i: Column) -> Column:
        plain = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
        return F.when(F.upper(w).isin(*UPPER_WORDS), F.upper(w)).when((i > 0) & F.lower(w).isin(*LOWER_WORDS), F.lower(w)).otherwise(plain)

    return F.array_join(F.transform(F.split(norm_text(c), " "), word), " ")


def clean(c: Column | str) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_text(*cols: Column | str) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*(clean(c) for c in cols))


def js_round(c: Column) -> Column:
    """Round half up, towards positive infinity."""
    return F.floor(c + 0.5)


def show_miles(miles: Column | str) -> Column:
    """Feet under a tenth of a mile, else miles with one decimal."""
    m = col(miles)
    return F.when(m < 0.1, F.format_string("%d ft", js_round(m * 5280).cast("long"))).otherwise(F.format_string("%.1f mi", m))


def show_traffic(aadt: Column | str, source: Column | str) -> Column:
    """Vehicles a day, rounded to thousands from 10,000, hundreds from 1,000, else fifties, and where they come from."""
    a = col(aadt)
    step = F.when(a >= 10000, 1000).when(a >= 1000, 100).otherwise(50)
    number = F.format_number((js_round(a / step) * step).cast("long"), 0)
    return F.when(a.isNull(), "Not on record").otherwise(F.concat(number, F.lit(" vehicles/day "), F.when(col(source) == 0, "(counted)").otherwise("(estimated)")))


def show_minutes(miles: Column | str) -> Column:
    """Minutes at ten miles an hour, one at least."""
    return F.greatest(F.lit(1), js_round(col(miles) / 10 * 60)).cast("long")


def plural(n: Column | str, one: str, many: str | None = None) -> Column:
    return F.format_string("%d %s", col(n).cast("long"), F.when(col(n) == 1, one).otherwise(many or one + "s"))
