"""Raw products of shops and crawls into the one canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vocabulary as V


def canonical(raw: DataFrame, shop: str) -> DataFrame:
    """Exports of one shop, in its own fields or canonical ones, as canonical products. Missing fields have defaults; the discount is truncated."""
    fields = {c: f for f, c in V.SHOP_FIELDS.get(shop, {}).items()}

    def field(name: str) -> Column:
        given = [F.col(f).cast("string") for f in (fields.get(name), name) if f in raw.columns]
        return F.coalesce(*given) if given else F.lit(None).cast("string")

    number = lambda c: F.coalesce(F.trim(F.regexp_replace(c, "[,₹$]", "")).try_cast("double"), F.lit(0.0))
    color, stock = F.lower(F.trim(field("color"))), F.lower(F.trim(field("in_stock")))
    colors = F.filter(F.transform(F.split(color, F.when(F.contains(color, F.lit(",")), F.lit(",")).otherwise(F.lit("/"))), lambda x: F.trim(x)), lambda x: x != "")
    price = number(field("price"))
    mrp = F.when(field("mrp").isNull(), price).otherwise(number(field("mrp")))
    category = F.lower(F.trim(F.coalesce(field("category"), F.lit(""))))
    pid = F.coalesce(*[F.col(c).cast("string") for c in ("_id", "id") if c in raw.columns], F.lit(""))
    rows = raw.select(
        F.concat(F.lit(f"{shop}_"), pid).alias("_id"), F.coalesce(field("name"), F.lit("Unknown Product")).alias("name"), F.coalesce(T.lookup(category, V.CATEGORY_ALIASES), category).alias("category"),
        F.coalesce(field("subcategory"), F.lit("")).alias("subcategory"), F.coalesce(field("brand"), F.lit("")).alias("brand"), F.coalesce(colors, F.array().cast("array<string>")).alias("color"),
        price.alias("price"), mrp.alias("mrp"), number(field("rating")).alias("rating"), number(field("review_count")).cast("int").alias("review_count"),
        F.when(field("in_stock").isNull(), F.lit(True)).when(stock.try_cast("double").isNotNull(), stock.try_cast("double") > 0).otherwise(stock.isin(V.IN_STOCK_WORDS)).alias("in_stock"),
        F.coalesce(field("image_url"), F.lit("")).alias("image_url"), F.lit(shop).alias("source"), F.coalesce(field("source_url"), F.concat(F.lit(f"https://{shop}.com/product/"), pid)).alias("source_url"), pid.alias("source_product_id"),
    )
    return rows.withColumns({"discount_percent": T.discount_truncated(F.col("price"), F.col("mrp")), "embedding_text": T.joined(F.col("name"), F.col("category"), F.array_join("color", " "))})


def infer_category(title: Column | str, product_type: Column | str, tags: Column | str) -> Column:
    """(category, subcategory) with most votes: 3 of the type (0.5 if it is a general one), 2.5 of the title's last garment word (4 of
    one that rules the title), 0.5 of its others, 1 of the tags; ties by order of the taxonomy. Null if nothing votes.

    The last word is the match that ends last, of those the longest; a match's end follows from what is left after it.
    """
    text, kind, tag = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (title, product_type, tags))
    weight = F.when(F.lower(F.trim(kind)).isin(V.GENERIC_TYPES), 0.5).otherwise(3.0)

    def candidate(order: int, name: str, group: str, pattern: str) -> Column:
        names = f"(?i){pattern}"
        hits, left = F.regexp_extract_all(text, F.lit(names), F.lit(0)), F.try_element_at(F.split(text, names, -1), F.lit(-1))
        # most names are not in a title: its words are only taken apart where one is
        place = F.when(F.rlike(text, F.lit(names)), F.struct(F.size(hits).alias("n"), (F.length(text) - F.length(left)).alias("end"), F.length(F.try_element_at(hits, F.lit(-1))).alias("size")))
        return F.struct(
            F.lit(name).alias("name"), F.lit(group).alias("group"), F.lit(-order).alias("order"), F.lit(name in V.DOMINANT_CATEGORIES).alias("rules"), place.alias("place"), (F.when(F.rlike(kind, F.lit(names)), weight).otherwise(0.0) + F.when(F.rlike(tag, F.lit(names)), 1.0).otherwise(0.0)).alias("others"),
        )

    def decided(all_: Column) -> Column:
        found = F.filter(all_, lambda c: c["place"].isNotNull())
        ruling = F.filter(found, lambda c: c["rules"])
        head = F.array_max(F.transform(F.when(F.size(ruling) > 0, ruling).otherwise(found), lambda c: F.struct(c["place"]["end"], c["place"]["size"], c["order"])))["order"]
        own = F.when(F.size(ruling) > 0, 4.0).otherwise(2.5)
        best = F.array_max(F.transform(all_, lambda c: F.struct((c["others"] + F.when(c["order"] == head, own).otherwise(F.coalesce(c["place"]["n"], F.lit(0)) * 0.5)).alias("votes"), c["order"], c["name"], c["group"])))
        voted = best["votes"] > 0
        return F.struct(F.when(voted, best["name"]).alias("category"), F.when(voted, best["group"]).alias("subcategory"))

    # an array of one binds the candidates to a name, so that they are worked out once
    return F.transform(F.array(F.array(*[candidate(i, *kind_) for i, kind_ in enumerate(V.taxonomy())])), decided)[0]


def with_categories(rows: DataFrame, title: str, product_type: str, tags: str, name: str) -> DataFrame:
    """rows with infer_category of the three columns (null: empty), which each three of them that differ is worked out for once, over all cores."""
    keys = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in (title, product_type, tags)}
    keyed = rows.withColumns(keys)
    kinds = keyed.select(*keys).distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
    return keyed.join(kinds.withColumn(name, infer_category(*keys)), list(keys)).drop(*keys)


def option_values(options: Column, variants: Column, names: list[str], available_only: bool = False) -> Column:
    """Distinct values that variants have of the option with one of the names; the declared ones if variants have none (unless available_only)."""
    place = F.array_position(F.transform(options, lambda o: F.lower(F.trim(o["name"])).isin(names)), True)
    pool = F.filter(variants, lambda v: F.coalesce(v["available"], F.lit(True))) if available_only else variants
    values = F.array_distinct(F.filter(F.transform(pool, lambda v: F.get(v["options"], (place - 1).cast("int"))), lambda x: x.isNotNull() & (x != "")))
    none = F.array().cast("array<string>")
    given = none if available_only else F.coalesce(F.get(options, (place - 1).cast("int"))["values"], none)
    return F.when((F.coalesce(place, F.lit(0)) == 0), none).when(F.size(values) > 0, values).otherwise(given)


def with_price(rows: DataFrame) -> DataFrame:
    """rows(variants) with price, mrp, in_stock of the cheapest variant that is available, of any if none is; rows without a price go.

    mrp is what the variant compares with where that is more than its price, else the price.
    """
    priced = F.filter(F.transform("variants", lambda v: F.struct(T.to_price(v["price"].cast("string")).alias("price"), T.to_price(v["compare_at_price"].cast("string")).alias("list"), F.coalesce(v["available"], F.lit(True)).alias("available"))), lambda v: v["price"] > 0)
    live = F.filter("_priced", lambda v: v["available"])
    first_min = lambda pool: F.aggregate(pool, F.get(pool, F.lit(0)), lambda a, v: F.when(v["price"] < a["price"], v).otherwise(a))
    found = rows.withColumn("_priced", priced).where(F.size("_priced") > 0).withColumn("_best", F.when(F.size(live) > 0, first_min(live)).otherwise(first_min(F.col("_priced"))))
    best = F.col("_best")
    mrp = F.when(best["list"] > best["price"], best["list"]).otherwise(best["price"])
    return found.withColumns({"price": best["price"], "mrp": mrp, "in_stock": F.exists("_priced", lambda v: v["available"])}).drop("_priced", "_best")


def of_fashion(title: Column, kind: Column, category: Column, opted_in: Column) -> Column:
    """Whether an item stays: its site takes all, or it has a category and neither title nor kind names something else."""
    return opted_in | category.isNotNull() & ~F.concat_ws(" | ", title, kind).rlike(V.NON_FASHION)


def normalized(raw: DataFrame, sites: DataFrame) -> DataFrame:
    """Crawled products (schema in schemas.RAW_PRODUCT, with site) as canonical ones; those unpriced or not of fashion are left out.

    sites(site, site_name, site_brand, default_gender, currency, include_non_fashion) is a small configuration table.
    """
    c = F.col
    rows = raw.join(sites, "site")
    title, vendor = T.collapsed(F.coalesce("title", F.lit(""))), T.collapsed(F.coalesce(F.nullif("vendor", F.lit("")), "brand", F.lit("")))
    swapped = T.looks_like_code(title) & (F.size(F.split(vendor, " ")) >= 3)
    rows = rows.withColumns({"kind": T.collapsed(F.coalesce("product_type", F.lit(""))), "model_code": F.when(swapped, title), "name": F.when(swapped, vendor).otherwise(title), "maker": F.when(swapped, F.lit("")).otherwise(vendor),
                             "all_tags": F.coalesce("tags", F.array().cast("array<string>")), "text": T.strip_html(c("description_html"))})
    rows = rows.where("name <> ''").withColumn("kind_of", infer_category("name", "kind", F.array_join("all_tags", " | ")))
    rows = with_price(rows)
    rows = rows.where(of_fashion(c("name"), c("kind"), c("kind_of.category"), c("include_non_fashion")))
    tag_colors = F.transform("all_tags", lambda t: F.regexp_replace(t, r"(?i)colou?r[_:\s-]*", " "))
    color_text = F.array_join(F.concat(F.array(F.coalesce("color", F.lit(""))), option_values(c("options"), c("variants"), ["color", "colour"]), F.array("name"), tag_colors), " | ")
    pid = F.coalesce(F.nullif("source_product_id", F.lit("")), "url")
    images = F.transform(F.filter(F.coalesce("images", F.array().cast("array<string>")), lambda i: i.isNotNull() & (i != "")), lambda i: F.when(F.startswith(i, F.lit("//")), F.concat(F.lit("https:"), i)).otherwise(i))
    out = rows.select(
        F.concat("site", F.lit("_"), T.safe_id(pid)).alias("_id"), "name", F.coalesce("kind_of.category", F.lit("other")).alias("category"), F.coalesce("kind_of.subcategory", F.lit("other")).alias("subcategory"), c("kind").alias("product_type"),
        F.coalesce("site_brand", F.nullif(T.nice_case(c("maker")), F.lit("")), "site_name").alias("brand"), T.infer_gender(F.concat_ws(" | ", "name", "kind", F.array_join("all_tags", " ")), c("default_gender")).alias("gender"),
        T.infer_colors([color_text]).alias("color"), T.infer_materials([c("name"), F.array_join("all_tags", " "), c("text")]).alias("material"), T.clean_tags(c("all_tags")).alias("tags"), "price", "mrp",
        T.discount_half_even(c("price"), c("mrp")).alias("discount_percent"), F.coalesce("currency", "site_currency").alias("currency"), F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("review_count", F.lit(0)).alias("review_count"),
        "in_stock", option_values(c("options"), c("variants"), ["size"]).alias("sizes"), option_values(c("options"), c("variants"), ["size"], True).alias("available_sizes"),
        F.coalesce(F.get(images, F.lit(0)), F.lit("")).alias("image_url"), F.slice(images, 1, 5).alias("images"), c("text").alias("description"), c("site").alias("source"), c("site_name").alias("source_name"), F.coalesce("url", F.lit("")).alias("source_url"),
        pid.alias("source_product_id"), "model_code", F.nullif("gtin", F.lit("")).alias("gtin"),
    )
    brand = F.when(F.contains(F.lower("name"), F.lower("brand")), F.lit("")).otherwise(c("brand"))
    return out.withColumn("embedding_text", T.joined(brand, c("name"), c("category"), c("subcategory"), F.array_join("color", " "), c("gender"), F.array_join("material", " "), c("product_type"), F.array_join(F.slice("tags", 1, 8), " ")))
