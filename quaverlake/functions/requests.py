"""What a request asks for, checked and clamped, and what it is told, in words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parameters of a saved recipe, and the rules of de-duplication.
WEIGHTS = ("clap", "lib", "genre", "bpm", "era", "loud")
SWITCHES = ("variety", "flow")
RULES = ("song", "title", "file")


def checked_params(given: Column) -> Column:
    """A JSON object of recipe parameters as a struct: ``error`` (null if all is well), and each parameter, clamped.

    Weights lie from 0 to 5 and sizes from 20 to 150; a null is like an absent one.
    """
    params = F.from_json(given, "map<string,string>")
    text = {k: F.element_at(params, k) for k in (*WEIGHTS, *SWITCHES, "dedup", "size")}
    number = {k: text[k].try_cast("double") for k in (*WEIGHTS, "size")}
    unknown = F.array_sort(F.filter(F.map_keys(params), lambda k: ~k.isin(*text)))

    def bad(k: str) -> Column:
        return text[k].isNotNull() & (number[k].isNull() | F.isnan(number[k]))

    error = (
        F.when(~F.coalesce(F.ltrim(given), F.lit("")).startswith("{") | params.isNull(), "params must be an object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown param(s): "), F.array_join(unknown, ", ")))
        .when(reduce(Column.__or__, map(bad, WEIGHTS)), "not a number")
        .when(text["dedup"].isNotNull() & ~text["dedup"].isin(*RULES), f"dedup must be one of {', '.join(RULES)}")
        .when(bad("size"), "size must be a number")
    )
    weights = [F.greatest(F.lit(0.0), F.least(F.lit(5.0), number[k])) for k in WEIGHTS]
    size = F.greatest(F.lit(20.0), F.least(F.lit(150.0), number["size"])).cast("int")
    switches = [text[k].isin("true", "1", "yes").cast("int") for k in SWITCHES]
    values = dict(zip((*WEIGHTS, *SWITCHES, "dedup", "size"), (*weights, *switches, text["dedup"], size), strict=True))
    return F.struct(error.alias("error"), *[F.when(error.isNull() & text[k].isNotNull(), v).alias(k) for k, v in values.items()])


def share(fit: Column) -> Column:
    """A fit as a percentage, half to even."""
    return F.concat(F.bround(fit * 100, 0).cast("int").cast("string"), F.lit("%"))


def gap_in_words(fit: Column, line: Column) -> Column:
    """How far below the line."""
    d = line - fit
    return F.when(d <= 0.02, "by a hair").when(d <= 0.10, "by a little").otherwise("by a long way")


def against_line(fit: Column, line: Column) -> Column:
    """A share beside the line's, or on which side it fell where both read the same."""
    a, b = share(fit), share(line)
    equal = F.when(fit < line, F.concat(F.lit("just under the cut-off of "), b)).otherwise(F.concat(F.lit("right at the cut-off of "), b))
    return F.when(a == b, equal).otherwise(F.concat(a, F.lit(" of a twin's score; the cut-off is "), b))


def agreement_in_words(cohesion: Column) -> Column:
    return F.when(cohesion >= 0.7, "agree strongly").when(cohesion >= 0.4, "agree somewhat").otherwise("barely agree")


def with_headroom(size: Column, banned: Column) -> Column:
    """How many to fetch, so that bans replace rows instead of shortening the list."""
    return F.when(banned, F.least(F.greatest(size * 3, size + 60), F.lit(400))).otherwise(size)


def fit_line(asked: Column, default: float) -> Column:
    """A line between 0 and 1; ``default`` for an absent one, null for what is no finite number."""
    v = asked.try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(asked.isNull() | (asked == ""), F.lit(default)).when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def floor_count(size: Column, part: Column, line: Column) -> Column:
    """How many rows a walk takes even below its line; null without a line or a floor."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    return F.when(line.isNotNull() & (part > 0), F.greatest(F.lit(1), F.ceil(size * part).cast("int")))


def scaled_floor(floor: Column, size: Column, want: Column) -> Column:
    """The floor of a walk that fetches ``want`` rows so that ``size`` remain."""
    return F.when(floor.isNull() | (want <= size), floor).otherwise(F.least(want, floor + (want - size)))


def window_at(values: Column, n: int, place: float) -> Column:
    """``n`` values about a ``place`` (0 to 1), inside where they fit, with zeros after fewer."""
    size = F.size(values)
    start = F.greatest(F.lit(0), F.least(F.floor(place * size).cast("int") - n // 2, size - n))
    cut = F.slice(values, start + 1, n)
    return F.concat(cut, F.transform(F.array_repeat(F.lit(0), F.greatest(F.lit(0), n - size)), lambda x: x.cast("double")))


def short_read(claimed: Column, got: Column, second: Column) -> Column:
    """True where a file gave under half of at least 20 claimed seconds, and a second reader half as much again."""
    return F.coalesce((claimed >= 20.0) & (got < claimed * 0.5) & (second > F.greatest(got, F.lit(1e-9)) * 1.5), F.lit(False))
