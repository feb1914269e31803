"""Keys and measures for recognising the same event: fingerprints, significant tokens, Jaccard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEFT, RIGHT, for_match

#: Words without weight for recognising an event.
STOP_WORDS = (
    "a ao aos as com consorcio consorcios da das de do dos e em intermunicipal municipal municipio municipios na nas no nos o os para por publico publicos que um uma diario oficial"
).split()
#: Words that a title fingerprint leaves out.
LINKING = "de|da|do|das|dos|e|em|no|na"
MOST_TOKENS, LEAD, SIMILAR, LEAST_TOKENS = 60, 700, 0.66, 4


def title_fingerprint(title: Column) -> Column:
    return F.sha2(F.regexp_replace(for_match(title), f"{LEFT}({LINKING}){RIGHT}", " "), 256)


def tokens(title: Column, text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Sorted distinct words of three letters or more of the title and the first LEAD characters of the text; the first MOST_TOKENS."""
    both = for_match(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, LEAD)))
    words = F.array_distinct(F.regexp_extract_all(both, F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return F.array_sort(F.slice(F.array_except(words, F.array(*[F.lit(w) for w in stop])), 1, MOST_TOKENS))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if either side is empty or null."""
    common, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / F.nullif(either, F.lit(0))).otherwise(F.lit(0.0))
