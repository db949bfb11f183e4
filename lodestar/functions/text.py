"""Column helpers for names, prices, sizes, tags and pages. Each takes and gives Columns and stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import vocabulary as V


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a small fixed table; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def either(names: list[str]) -> str:
    """A pattern of any of the names, longest first."""
    quoted = [n.replace("&", r"\&").replace("-", r"\-") for n in sorted(names, key=len, reverse=True)]
    return "|".join(quoted)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: What tokens() deletes among the letters and marks of most texts: a translation is far quicker than a regular expression.
_DELETED = "".join(chr(i) for i in range(1, 0x180) if not ("a" <= chr(i) <= "z" or "0" <= chr(i) <= "9" or chr(i) == " "))


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits; any other character but a space is deleted, so it joins its neighbours."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), _DELETED, "")
    # as many bytes as characters: nothing beyond ASCII is left
    clean = F.when((F.octet_length(plain) == F.length(plain)) & ~F.contains(plain, F.lit("\0")), plain).otherwise(F.regexp_replace(plain, "[^a-z0-9 ]+", ""))
    return F.array_remove(F.split(clean, " "), "")


def title_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(V.TITLE_STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of arrays of distinct values, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def half_up(c: Column, places: int) -> Column:
    """Rounded by floor(x * 10^places + 0.5): the same in every engine, unlike round()."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def to_price(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^0-9.]", ""), F.lit("")).try_cast("double")


#: Named and numbered entities that native expressions undo; `unescape` in sources.pages knows all.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def strip_html(c: Column, limit: int = 500) -> Column:
    """Text of markup: tags become spaces, common entities are undone, space is collapsed, cut at a word with an ellipsis."""
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    plain = collapsed(plain)
    head = F.substring(plain, 1, limit)
    return F.when(F.length(plain) > limit, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("…"))).otherwise(plain)


def nice_case(c: Column) -> Column:
    """Title case for names that are all upper or all lower case; hyphens become spaces."""
    text = F.trim(F.replace(c, F.lit("-"), F.lit(" ")))
    cased = (F.upper(text) != F.lower(text)) & ((text == F.upper(text)) | (text == F.lower(text)))
    return F.when(cased, F.initcap(collapsed(text))).otherwise(text)


def looks_like_code(c: Column) -> Column:
    return F.trim(c).rlike(V.CODE_PATTERN)


def clean_tags(tags: Column) -> Column:
    flat = F.transform(tags, collapsed)
    good = F.filter(flat, lambda t: ~t.rlike(V.TAG_NOISE) & (F.length(t) <= 30) & (F.size(F.split(t, " ")) <= 4))
    return F.array_distinct(F.transform(good, F.lower))


def normalize_size(c: Column) -> Column:
    """One spelling of a size; null for nothing."""
    up = F.upper(collapsed(c))
    bare = F.regexp_replace(F.regexp_replace(up, r"^(?:UK|IND|IN) *-? *([0-9])", "$1"), r"([0-9]) *(?:UK|IND)$", "$1")
    one = F.replace(F.coalesce(lookup(bare, V.SIZE_ALIASES), bare), F.lit(" "), F.lit(""))
    return F.when(up == "", F.lit(None)).when(up.isin(V.ONE_SIZE_NAMES), F.lit("ONE SIZE")).otherwise(one)


def size_order(c: Column) -> Column:
    """A sort key: letter sizes by the ladder, then numbers, then the rest by text."""
    letter = F.array_position(strings(V.LETTER_SIZES), c)
    digits = c.rlike("^[0-9]+$")
    kind = F.when(letter > 0, 0).when(digits, 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.when(letter > 0, letter).when(digits, c.try_cast("long")).otherwise(F.lit(0)).cast("long").alias("n"), F.when(kind == 2, c).otherwise(F.lit("")).alias("text"))


def size_available(want: Column, sizes: Column, available: Column) -> Column:
    """Whether an item can be had in a size: always without a size, size data, or with one size only; null `available` means `sizes`."""
    every = F.transform(sizes, normalize_size)
    no_choice = F.forall(every, lambda s: s.isNull() | (s == "ONE SIZE"))
    pool = F.transform(F.coalesce(available, sizes), normalize_size)
    asked = normalize_size(want)
    return F.coalesce(asked.isNull() | sizes.isNull() | (F.size(sizes) == 0) | no_choice | F.exists(pool, lambda s: s == asked), F.lit(False))


def category_matches(want: Column, category: Column, text: Column) -> Column:
    """Whether an item is of a category: by name or synonym; not if it is of another known one; else by whole words in its text."""
    want = F.lower(F.trim(want))
    own = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    table = F.create_map(*[x for k, v in V.CATEGORY_SYNONYMS.items() for x in (F.lit(k), strings(v))])
    names = F.array_union(F.array(want), F.coalesce(F.try_element_at(table, want), strings([])))
    words = F.exists(names, lambda n: F.rlike(F.lower(text), F.concat(F.lit(r"\b"), F.regexp_replace(n, r"([^a-z0-9 ])", r"\\$1"), F.lit(r"\b"))))
    return F.when(want.isNull() | (want == ""), F.lit(True)).when(F.array_contains(names, own), F.lit(True)).when(own.isin(list(V.CATEGORY_SYNONYMS)), F.lit(False)).otherwise(words)


def infer_colors(texts: list[Column]) -> Column:
    """Colour names in order of the texts, each followed by its families, without repeats."""
    pattern = rf"(?i)\b({either([*V.COLOR_FAMILIES, 'off-white'])})\b"
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), 1) for t in texts]))
    names = F.transform(found, lambda n: F.trim(F.replace(F.lower(n), F.lit("-"), F.lit(" "))))
    table = F.create_map(*[x for k, v in V.COLOR_FAMILIES.items() for x in (F.lit(k), strings([k, *v]))])
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), strings([])))))


def infer_materials(texts: list[Column]) -> Column:
    pattern = rf"(?i)\b({either(V.MATERIALS)})\b"
    return F.array_distinct(F.transform(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), 1) for t in texts])), F.lower))


def infer_gender(text: Column, default: Column) -> Column:
    hit = {g: text.rlike(p) for g, p in V.GENDER_PATTERNS.items()}
    return F.when(hit["unisex"] | (hit["men"] & hit["women"]), F.lit("unisex")).when(hit["women"], F.lit("women")).when(hit["men"], F.lit("men")).otherwise(default)


def discount_half_even(price: Column, mrp: Column) -> Column:
    return F.when((mrp > 0) & (mrp > price), F.bround((mrp - price) / mrp * 100, 0).cast("int")).otherwise(F.lit(0))


def discount_truncated(price: Column, mrp: Column) -> Column:
    return F.when((mrp > 0) & (mrp > price), (((mrp - price) / mrp) * 100).cast("int")).otherwise(F.lit(0))


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def joined(*parts: Column) -> Column:
    """Non-empty parts with single spaces between."""
    return collapsed(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " "))


def thumbnail_url(url: Column, width: int) -> Column:
    """A shop CDN's image address with its width parameter set; other addresses unchanged."""
    host, path, query = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    rest = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("width="))
    set_ = F.concat(F.regexp_extract(url, "^([a-zA-Z]+)://", 1), F.lit("://"), host, path, F.lit("?"), F.array_join(F.concat(rest, F.array(F.lit(f"width={width}"))), "&"))
    return F.when(host.contains("cdn.shopify.com") | path.contains("/cdn/shop/"), set_).otherwise(url)


def lenient_json(c: Column) -> Column:
    """JSON text with the commas before closing brackets taken out."""
    return F.regexp_replace(F.trim(c), r",\s*([}\]])", "$1")
