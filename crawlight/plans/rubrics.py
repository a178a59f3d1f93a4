"""Whether pages answer their visitors: facts by page type, questions by site category.

A page is looked up for all stems of all packs in its own row; only stems that
were found leave it, and a site keeps the set of them, whose size the packs
bound.  Packs are small and fixed, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A page is read so far, by the rule itself.
READ = 5000
#: Stems are longer than this; a question is open below this coverage.
SHORT, LEAST_COVERAGE = 3, 0.4

# Categories by the page types of a site, in order of precedence.
CATEGORIES = [
    ("ECOMMERCE", ["product", "product_detail"]),
    ("DOCUMENTATION", ["docs", "documentation"]),
    ("BLOG_NEWS", ["article", "blog"]),
]
OTHER = "GENERIC"

# Category, type of question, components of an answer.
RUBRICS = [
    ("ECOMMERCE", "suitability", ["product_specifications", "compatibility_or_fit", "material_or_ingredients", "target_audience"]),
    ("ECOMMERCE", "commercial", ["unit_price_and_currency", "stock_availability", "discounts_or_bulk_pricing", "taxes_or_fees"]),
    ("ECOMMERCE", "fulfillment", ["shipping_destinations_and_fees", "delivery_timeframes", "return_window_days", "refund_or_exchange_terms"]),
    ("SAAS", "capability", ["primary_features", "supported_integrations", "supported_platforms_or_browsers", "system_requirements"]),
    ("SAAS", "commercial", ["plan_comparison_matrix", "monthly_vs_annual_pricing", "seat_or_usage_limits", "trial_terms_no_credit_card"]),
    ("SAAS", "onboarding", ["quickstart_guide", "api_documentation_link", "migration_or_import_support", "sla_guarantees"]),
    ("BLOG_NEWS", "explanation", ["executive_summary_or_abstract", "key_factual_takeaways", "author_credentials_and_byline", "publication_or_revision_date"]),
    ("BLOG_NEWS", "evidence", ["named_citations_or_studies", "numerical_data_or_statistics", "direct_quotes_from_authorities", "methodology_explanation"]),
    ("DOCUMENTATION", "instructional", ["prerequisites_and_dependencies", "annotated_code_samples", "parameter_and_type_definitions", "expected_response_or_output"]),
    ("DOCUMENTATION", "troubleshooting", ["error_code_or_message", "root_cause_explanation", "step_by_step_fix", "fallback_or_workaround"]),
    ("B2B_SERVICES", "suitability", ["industry_specializations", "case_studies_with_metrics", "client_logos_or_testimonials", "compliance_certifications"]),
    ("B2B_SERVICES", "engagement", ["service_deliverables_scope", "engagement_timeline", "pricing_model_fixed_vs_hourly", "sales_contact_or_calendar_booking"]),
    ("LOCAL_BUSINESS", "visitation", ["physical_street_address", "daily_operating_hours", "phone_number_and_email", "parking_or_transit_instructions"]),
    ("LOCAL_BUSINESS", "offerings", ["menu_or_service_list", "appointment_booking_link", "pricing_or_payment_options"]),
    ("GENERIC", "suitability", ["clear_brand_identity", "target_audience_definition", "core_offerings_summary"]),
    ("GENERIC", "actionability", ["primary_navigation_routes", "contact_or_support_links", "authoritative_about_page"]),
]

# Facts that a page type owes its visitors.
REQUIRED_FACTS = {
    "pricing": ["tier_names", "price_points", "billing_interval", "feature_matrix", "commercial_cta"],
    "product_detail": ["product_name", "price", "availability", "specifications", "purchase_cta"],
}
# Patterns by which a fact is found; facts without one are never missed.
FACT_PATTERNS = {
    "tier_names": "(starter|pro|enterprise|basic|premium|free|standard|advanced|tier|plan)",
    "billing_interval": " (month|year|annual|mo|yr|monthly|annually) ",
    "tier_prices": r"(\$|€|£|¥|\d+\.\d{2})",
    "feature_matrix": " (feature|compare|include|matrix|custom) ",
    "signup_or_trial_cta": " (sign up|try|trial|get started|start|subscribe) ",
    "availability": " (stock|sold out|available|backorder) ",
    "add_to_cart_or_buy_cta": " (add to cart|buy|purchase|checkout) ",
}


def stems(component: str) -> list[str]:
    return [s for s in component.split("_") if len(s) > SHORT]


def all_stems() -> list[str]:
    return sorted({s for _, _, components in RUBRICS for c in components for s in stems(c)})


def missing_facts(text: Column, page_type: Column, required: dict[str, list[str]] = REQUIRED_FACTS) -> Column:
    """Facts that the page type requires and the text lacks, in order; null text lacks all, other types none."""
    low = F.coalesce(F.lower(text), F.lit(""))
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for kind, facts in required.items():
        lacks = [F.when(~low.rlike(FACT_PATTERNS[f]), F.lit(f)) for f in facts if f in FACT_PATTERNS]
        out = out.when(page_type == kind, F.array_compact(F.array(*lacks)) if lacks else F.array().cast("array<string>"))
    return out.otherwise(F.array().cast("array<string>"))


def rubric_coverage(pages: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """site, category, type, components, missing, coverage: how far a site answers the questions of its category.

    ``pages`` has site, page_type and text; ``categories`` (site, category) states known
    categories, others follow from page types.  A category without a pack takes that of
    GENERIC, under its own name.  A component counts as answered if one of its stems occurs in
    some page's first READ characters; one without stems is never missing.  Null text
    has no stems, a null site is a site; no pages give no rows.
    """
    low = F.lower(F.substring("text", 1, READ))
    found = F.filter(F.array(*map(F.lit, all_stems())), lambda s: low.contains(s))
    rank = F.lit(len(CATEGORIES))
    for k, (_, kinds) in reversed(list(enumerate(CATEGORIES))):
        rank = F.when(F.col("page_type").isin(kinds), k).otherwise(rank)
    per_page = pages.select("site", rank.alias("rank"), F.explode_outer(found).alias("stem"))
    sites = per_page.groupBy("site").agg(F.min("rank").alias("rank"), F.collect_set("stem").alias("found"))
    names = F.array(*(F.lit(name) for name, _ in CATEGORIES), F.lit(OTHER))
    sites = sites.select("site", "found", names[F.col("rank")].alias("derived"))
    if categories is None:
        sites = sites.withColumnRenamed("derived", "category")
    else:
        known = categories.groupBy(F.col("site").alias("known_site")).agg(F.min("category").alias("known"))
        sites = sites.join(known, F.col("site").eqNullSafe(F.col("known_site")), "left").select("site", "found", F.coalesce("known", "derived").alias("category"))
    spark = pages.sparkSession
    rows = [(category, kind, [(c, stems(c)) for c in components]) for category, kind, components in RUBRICS]
    packs = spark.createDataFrame(rows, "pack string, type string, components array<struct<component string, stems array<string>>>")
    has_pack = F.col("category").isin(sorted({category for category, _, _ in RUBRICS}))
    sites = sites.withColumn("pack", F.when(has_pack, F.col("category")).otherwise(OTHER))
    asked = sites.join(F.broadcast(packs), "pack")
    open_parts = F.filter("components", lambda c: (F.size(c["stems"]) > 0) & ~F.arrays_overlap(c["stems"], F.col("found")))
    asked = asked.select("site", "category", "type", F.size("components").cast("long").alias("components"), F.transform(open_parts, lambda c: c["component"]).alias("missing"))
    return asked.withColumn("coverage", (F.col("components") - F.size("missing")) / F.col("components"))


def open_questions(coverage: DataFrame) -> DataFrame:
    """site, id, missing: recommendations where less than LEAST_COVERAGE is answered, with the first three missing components."""
    flagged = coverage.where((F.col("coverage") < LEAST_COVERAGE) & (F.size("missing") > 0))
    name = F.concat_ws(".", F.lit("PROACTIVE.GEO.QUERY_RUBRIC"), "category", F.upper("type"))
    return flagged.select("site", name.alias("id"), F.array_join(F.slice("missing", 1, 3), ", ").alias("missing"))
