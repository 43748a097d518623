"""Query callables for web-page extraction (§2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from concourse.operators import pages as pg
from concourse.operators.nesting import nest_by_page
from concourse.plans import fixtures as fx
from concourse.session import read_table, spread


def _pages(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def q_filter_detail_links(spark, sf_dir):
    return pg.filter_detail_links(_pages(spark, sf_dir), needle="/the")


def _objects(spark, sf_dir):
    return pg.embedded_json_repair(pg.embedded_object_text(fx.embedded_pages(spark, sf_dir)))


def q_embedded_json_extract(spark, sf_dir):
    return pg.embedded_json_extract(fx.embedded_pages(spark, sf_dir))


def q_embedded_json_repair(spark, sf_dir):
    m = pg.parse_region_map(_objects(spark, sf_dir))
    return m.select("page_id", F.col("regions").isNotNull().alias("valid"),
                    F.coalesce(F.size("regions"), F.lit(0)).alias("n_regions"))


def _items(spark, sf_dir):
    return pg.region_airports_flatten(pg.embedded_json_extract(fx.embedded_pages(spark, sf_dir)))


def q_region_airports_flatten(spark, sf_dir):
    return _items(spark, sf_dir)


def q_airport_country(spark, sf_dir):
    return pg.airport_country(_items(spark, sf_dir))


def q_filter_countries(spark, sf_dir):
    return pg.filter_countries(pg.airport_country(_items(spark, sf_dir)))


def q_page_header_fields(spark, sf_dir):
    return pg.page_header_fields(_pages(spark, sf_dir))


def q_card_explode(spark, sf_dir):
    # the pages table links its cards by other paths than ``/lounges/``
    return pg.card_explode(_pages(spark, sf_dir), needle="").drop("card")


def q_detail_key(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", "url", pg.detail_key(F.col("url")).alias("detail_key"))


def _good_cards(spark, sf_dir):
    good, _bad = pg.quarantine(pg.parse_cards(fx.lounge_cards(spark, sf_dir)))
    return good


def q_field_defaults(spark, sf_dir):
    return _good_cards(spark, sf_dir).select("lounge_id", "terminal", "opening_hours", "image_url")


def q_amenity_format(spark, sf_dir):
    return pg.amenity_format(fx.detail_pages(spark, sf_dir)).select("url", "amenities")


def q_section_items(spark, sf_dir):
    d = pg.section_items(fx.detail_pages(spark, sf_dir), "Location", "location_items")
    d = pg.section_items(d, "Conditions", "conditions")
    return d.select("url", F.array_join("location_items", "|").alias("location_items"),
                    F.size("location_items").alias("n_location"),
                    F.array_join("conditions", "|").alias("conditions"),
                    F.size("conditions").alias("n_conditions"))


def q_access_notes(spark, sf_dir):
    d = pg.section_items(fx.detail_pages(spark, sf_dir), "Location", "location_items")
    return pg.access_notes(d).select("url", "access_notes")


def joined_lounges(spark, sf_dir):
    return pg.detail_join(_good_cards(spark, sf_dir), pg.parse_details(fx.detail_pages(spark, sf_dir)))


def q_detail_join(spark, sf_dir):
    j = joined_lounges(spark, sf_dir)
    return j.select("lounge_id", "name", "amenities", "access_notes",
                    F.array_join("conditions", "|").alias("conditions_text"))


def q_nest_lounges(spark, sf_dir):
    fields = ["lounge_id", "name", "terminal", "opening_hours", "image_url", "detail_url",
              "amenities", "access_notes", "conditions"]
    last = fx.read_table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0
    pages = fx.catalog_pages(fx.airports(spark, sf_dir).drop("_null_array"), last)
    nested = nest_by_page(fx.on_pages(joined_lounges(spark, sf_dir), F.col("k")), pages, fields)
    flat = nested.select("airport_code", F.explode_outer("lounges").alias("l"))
    return flat.groupBy("airport_code").agg(
        F.count("l.lounge_id").alias("n_lounges"),
        F.min("l.lounge_id").alias("first_lounge_id"),
        F.max("l.lounge_id").alias("last_lounge_id"))


def q_quarantine_bad_records(spark, sf_dir):
    c = pg.parse_cards(fx.lounge_cards(spark, sf_dir))
    return c.select("k", "lounge_id",
                    F.when(F.col("reject_reason").isNull(), F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
                    "reject_reason")


QUERIES = {
    "filter_detail_links": q_filter_detail_links,
    "embedded_json_extract": q_embedded_json_extract,
    "embedded_json_repair": q_embedded_json_repair,
    "region_airports_flatten": q_region_airports_flatten,
    "airport_country": q_airport_country,
    "filter_countries": q_filter_countries,
    "page_header_fields": q_page_header_fields,
    "card_explode": q_card_explode,
    "detail_key": q_detail_key,
    "field_defaults": q_field_defaults,
    "amenity_format": q_amenity_format,
    "section_items": q_section_items,
    "access_notes": q_access_notes,
    "detail_join": q_detail_join,
    "nest_lounges": q_nest_lounges,
    "quarantine_bad_records": q_quarantine_bad_records,
}
