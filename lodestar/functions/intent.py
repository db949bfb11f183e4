"""What a shopping query asks for, as native column expressions over a DataFrame of many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import vocabulary as V
from lodestar.functions.text import collapsed, normalize_size, strings


def _group(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches anywhere; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def without_size(text: Column) -> Column:
    """The text without the phrase of the first size pattern that matches."""
    out = text
    for p in reversed(V.SIZE_PATTERNS):
        out = F.when(text.rlike(p), collapsed(F.regexp_replace(text, rf"(?s)^(.*?){p}(.*)$", "$1 $3"))).otherwise(out)
    return out


def whole_word(words: list[str]) -> str:
    return r"\b(?:" + "|".join(w.replace("&", r"\&") for w in words) + r")\b"


def parse_queries(queries: DataFrame) -> DataFrame:
    """queries(query_id, text) with size, cleaned, colors, max_price, min_rating, brand, category, terms (sorted) and bindings.

    A null text asks for nothing. Repeated queries cost as often as they come: drop duplicates first (`distinct_queries`).
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    base = queries.withColumns({"size": normalize_size(_group(low, V.SIZE_PATTERNS)), "cleaned": without_size(low)})
    q = F.col("cleaned")
    star = F.regexp_extract(q, r"(\d+(?:\.\d+)?)\s*\+?\s*(?:star|rating)", 1)
    parsed = base.withColumns({
        "colors": F.filter(strings(V.QUERY_COLORS), lambda c: F.rlike(q, F.concat(F.lit(r"\b"), c, F.lit(r"\b")))),
        "max_price": _group(q, V.MAX_PRICE_PATTERNS).try_cast("double"),
        "min_rating": F.coalesce(F.nullif(star, F.lit("")), F.nullif(F.regexp_extract(q, r"above\s+(\d+(?:\.\d+)?)", 1), F.lit(""))).try_cast("double"),
        "brand": F.coalesce(*[F.when(q.rlike(whole_word([b])), F.lit(b.capitalize())) for b in V.QUERY_BRANDS]),
        "category": F.coalesce(*[F.when(q.rlike(whole_word([c, *s])), F.lit(c)) for c, s in V.CATEGORY_SYNONYMS.items()]),
    })
    names = F.create_map(*[x for c, s in V.CATEGORY_SYNONYMS.items() for x in (F.lit(c), strings(list(dict.fromkeys([c, *s]))))])
    typed = F.filter(F.coalesce(F.try_element_at(names, F.col("category")), strings([])), lambda w: (w == F.col("category")) | F.rlike(q, F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))
    own = F.filter(F.regexp_extract_all(q, F.lit("[a-z0-9-]+"), 0), lambda w: ~w.isin(V.QUERY_STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    found = F.concat(typed, own)
    some = F.when(F.size(found) > 0, found).when(F.size("colors") > 0, F.col("colors")).otherwise(F.array(q))
    more = F.flatten(F.transform("colors", lambda c: F.when(c == "red", strings(["red", "maroon"])).when(c == "blue", strings(["blue", "navy"])).otherwise(F.array(c))))
    binding = r"(\w+)\s+(\w+)\s+(?:and|with|&)\s+(\w+)\s+(\w+)"
    c1, i1, c2, i2 = (F.regexp_extract(q, binding, k) for k in range(1, 5))
    pairs = F.array(F.when(c1.isin(V.QUERY_COLORS), F.struct(i1.alias("item"), c1.alias("color"))), F.when(c2.isin(V.QUERY_COLORS), F.struct(i2.alias("item"), c2.alias("color"))))
    # of two bindings of one item the later holds
    kept = F.array_compact(pairs)
    last = F.when((F.size(kept) == 2) & (i1 == i2), F.slice(kept, 2, 1)).otherwise(kept)
    return parsed.withColumns({"terms": F.sort_array(F.array_distinct(F.concat(some, more))), "bindings": F.map_from_entries(last)})


def distinct_queries(queries: DataFrame) -> DataFrame:
    """(key, text): each query once, by its trimmed lower-case text."""
    return queries.select(F.lower(F.trim("text")).alias("key"), "text").groupBy("key").agg(F.min("text").alias("text"))


PARSED = ("size", "cleaned", "colors", "max_price", "min_rating", "brand", "category", "terms", "bindings")


def parsed_by_cache(queries: DataFrame, cache: DataFrame, now: Column, ttl: int = 3600) -> tuple[DataFrame, DataFrame]:
    """What queries(query_id, text) ask for, parsed only where the cache has no fresh answer, and the cache as it is afterwards.

    cache(key, intent struct of PARSED, parsed_at) answers under a query's trimmed lower-case text (a null text's is empty) for ttl
    seconds from parsed_at; of repeated keys the newest counts, and a use doesn't prolong it. The first result is queries with intent,
    parsed_at and cached; the second has what was fresh and what was parsed now, without what has expired. Each text that is
    missing is parsed once, however often it is asked.
    """
    own = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    fresh = cache.where(F.col("parsed_at") + F.make_dt_interval(secs=F.lit(ttl)) > now).groupBy("key").agg(F.max_by("intent", "parsed_at").alias("intent"), F.max("parsed_at").alias("parsed_at"))
    missing = queries.select(own.alias("key")).distinct().join(fresh, "key", "left_anti")
    parsed = parse_queries(missing.withColumn("text", F.col("key"))).select("key", F.struct(*PARSED).alias("intent"), now.cast("timestamp").alias("parsed_at"))
    after = fresh.withColumn("cached", F.lit(True)).unionByName(parsed.withColumn("cached", F.lit(False)))
    asked = queries.withColumn("_key", own)
    return asked.join(after, asked["_key"] == after["key"]).drop("_key", "key"), after.drop("cached")
