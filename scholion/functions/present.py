"""Display columns: author names and summaries, snippets, highlights, links, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import nullif_empty, quote_regex, strip

# Link prefixes.
DOI_URL = "https://doi.org/"
PMC_URL = "https://www.ncbi.nlm.nih.gov/pmc/articles/"


def author_names(authors: Column) -> Column:
    """Given names and surname of each author, blank parts left out."""
    return F.transform(
        authors,
        lambda a: F.concat_ws(
            " ", nullif_empty(a["given_names"]), nullif_empty(a["surname"])
        ),
    )


def author_summary(names: Column) -> Column:
    n = F.coalesce(F.size(names), F.lit(0))
    return (
        F.when(n <= 0, F.lit("Unknown authors"))
        .when(n == 1, names[0])
        .when(n == 2, F.concat(names[0], F.lit(" and "), names[1]))
        .when(n == 3, F.concat(names[0], F.lit(", "), names[1], F.lit(", and "), names[2]))
        .otherwise(F.concat(names[0], F.lit(" et al.")))
    )


def snippet(text: Column, limit: int = 300) -> Column:
    """At most limit characters, the dots included."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    )


def highlight(
    text: Column, query: Column, opening: str = "<mark>", closing: str = "</mark>"
) -> Column:
    """Wrap each case-insensitive literal occurrence of the query in a tag."""
    pattern = F.concat(F.lit("(?iu)("), quote_regex(query), F.lit(")"))
    return F.when(F.length(strip(query)) == 0, text).otherwise(
        F.regexp_replace(text, pattern, F.lit(f"{opening}$1{closing}"))
    )


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit(DOI_URL), nullif_empty(doi))


def pmc_url(pmcid: Column) -> Column:
    return F.concat(F.lit(PMC_URL), nullif_empty(pmcid), F.lit("/"))


def percent(score: Column) -> Column:
    return F.concat(F.format_string("%.1f", score.cast("double") * 100), F.lit("%"))


def date_text(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMM d, yyyy"), F.lit("Unknown date"))


def token_text(n: Column) -> Column:
    return F.when(n.isNull(), F.lit("")).otherwise(
        F.concat(F.format_number(n, 0), F.lit(" tokens"))
    )


def time_ago(ts: Column, now: Column) -> Column:
    """Age in the largest whole unit up to six days, afterwards the date."""
    seconds = F.floor(
        (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000
    )
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))

    def unit(n: Column, suffix: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f"{suffix} ago"))

    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(minutes < 60, unit(minutes, "m"))
        .when(hours < 24, unit(hours, "h"))
        .when(days < 7, unit(days, "d"))
        .otherwise(F.date_format(ts, "M/d/yyyy"))
    )


def split_names(text: Column) -> Column:
    """A comma list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
