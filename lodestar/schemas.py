"""Schemas of the tables that the package reads and writes."""

from __future__ import annotations

VARIANT = "struct<price: string, compare_at_price: string, available: boolean, options: array<string>, sku: string>"
RAW_FIELDS = {
    "source_product_id": "string", "url": "string", "title": "string", "vendor": "string", "brand": "string", "product_type": "string", "tags": "array<string>", "description_html": "string",
    "images": "array<string>", "options": "array<struct<name: string, values: array<string>>>", "variants": f"array<{VARIANT}>", "color": "string", "rating": "double", "review_count": "int",
    "currency": "string", "gtin": "string",
}
RAW_PRODUCT = ", ".join(f"{name} {kind}" for name, kind in RAW_FIELDS.items())
PRODUCT = (
    "_id string, name string, category string, subcategory string, product_type string, brand string, gender string, color array<string>, material array<string>, tags array<string>, price double, mrp double, "
    "discount_percent int, currency string, rating double, review_count int, in_stock boolean, sizes array<string>, available_sizes array<string>, image_url string, images array<string>, description string, "
    "embedding_text string, source string, source_name string, source_url string, source_product_id string, scraped_at string, first_seen string, model_code string, gtin string"
)
CHANGE = "_action string, _id string, name string, category string, brand string, price double, mrp double, in_stock boolean, seq long"
CLICK = "id long, query string, shown_results string, clicked_id string, timestamp string, query_id string, position int"
IMPRESSION = "query_id string, query string, mode string, position int, product_id string, features array<double>, feature_version int, model_version string, timestamp string"
FEED = (
    "products array<struct<id: long, title: string, handle: string, vendor: string, product_type: string, tags: string, body_html: string, options: array<struct<name: string, values: array<string>>>, "
    "variants: array<struct<price: string, compare_at_price: string, available: boolean, option1: string, option2: string, option3: string, sku: string>>, images: array<struct<position: int, src: string>>>>"
)
