"""Site archetypes from weighted evidence, and site types by cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evidence of each category, in the order that breaks ties.
SCHEMAS = {
    "ECOMMERCE": ["Product", "Offer", "AggregateOffer", "IndividualProduct", "ItemAvailability", "MerchantReturnPolicy"],
    "SAAS": ["SoftwareApplication", "WebApplication", "MobileApplication"],
    "LOCAL_BUSINESS": ["LocalBusiness", "Store", "Restaurant", "FoodEstablishment", "ProfessionalService", "MedicalBusiness"],
    "B2B_SERVICES": ["Service", "ProfessionalService", "Organization", "Corporation"],
    "PORTFOLIO": ["Person", "ProfilePage"],
    "BLOG_NEWS": ["Article", "NewsArticle", "BlogPosting", "TechArticle", "Report"],
    "DOCUMENTATION": ["TechArticle", "APIReference", "HowTo", "Guide"],
    "EDUCATION": ["Course", "EducationalOccupationalProgram", "Syllabus"],
    "COMMUNITY": ["DiscussionForumPosting", "QAPage", "Comment"],
    "MEDIA": ["VideoObject", "AudioObject", "MediaObject", "PodcastSeries", "PodcastEpisode"],
}
PATHS = {
    "ECOMMERCE": ["/product", "/cart", "/checkout", "/shop", "/item", "/buy", "/catalog", "/store", "/p/"],
    "SAAS": ["/pricing", "/features", "/integrations", "/signup", "/trial", "/app", "/dashboard", "/login"],
    "LOCAL_BUSINESS": ["/locations?", "/find-a-store", "/directions", "/hours", "/contact-us", "/visit"],
    "B2B_SERVICES": ["/services", "/solutions", "/case-studies", "/enterprise", "/consulting", "/clients"],
    "PORTFOLIO": ["/portfolio", "/projects", "/resume", "/cv", "/about-me", "/works"],
    "BLOG_NEWS": ["/blog", "/news", "/article", "/post", "/press-release", "/stories", "/journal"],
    "DOCUMENTATION": ["/docs", "/documentation", "/api", "/guide", "/reference", "/sdk", "/tutorial"],
    "EDUCATION": ["/courses", "/curriculum", "/learn", "/lessons", "/academy", "/training", "/syllabus"],
    "COMMUNITY": ["/community", "/forum", "/discussions", "/topics", "/members", "/questions"],
    "MEDIA": ["/video", "/watch", "/podcast", "/listen", "/media", "/episodes", "/audio"],
}
LABELS = {
    "ECOMMERCE": ["add to cart", "buy now", "in stock", "out of stock", "free shipping", "shopping bag", "shopping cart", "price:", "$", "usd"],
    "SAAS": ["start free trial", "request demo", "view pricing", "free 14-day trial", "api documentation", "sign up free", "log in to dashboard"],
    "LOCAL_BUSINESS": ["opening hours", "get directions", "visit us", "call today", "book table", "reserve a table", "our location"],
    "B2B_SERVICES": ["contact sales", "schedule consultation", "our clients", "case studies", "enterprise solution", "talk to an expert"],
    "PORTFOLIO": ["selected works", "my experience", "about me", "view projects", "creative developer", "designer & developer"],
    "BLOG_NEWS": ["published on", "min read", "author:", "related articles", "newsletter", "leave a comment", "editor's pick"],
    "DOCUMENTATION": ["getting started", "code snippet", "sdk reference", "quickstart", "parameters", "response syntax", "prerequisites"],
    "EDUCATION": ["enroll now", "course syllabus", "instructor:", "certificate", "prerequisites", "lesson plan", "students enrolled"],
    "COMMUNITY": ["latest topics", "replies", "joined", "post reply", "community guidelines", "thread", "moderator"],
    "MEDIA": ["watch episode", "play audio", "subscribe to podcast", "listen now", "view stream", "episodes"],
}
PAGE_TYPES = {
    "ECOMMERCE": ["product", "product_listing", "product_detail", "subscription_flow", "cart", "checkout"],
    "BLOG_NEWS": ["article", "blog_post", "news"],
    "LOCAL_BUSINESS": ["location", "store_locator"],
    "DOCUMENTATION": ["docs", "documentation", "api_reference"],
}
CHECK_PREFIXES = {"ECOMMERCE": "EC", "B2B_SERVICES": "BC", "BLOG_NEWS": "BN", "EDUCATION": "ED", "MEDIA": "ME"}
CATEGORIES = list(SCHEMAS)
#: Points of a family, labels that must be seen together, characters of text that labels are sought in, least score and families.
POINTS = {"schema_org": 4, "label_cues": 3, "inventory_type": 2, "url_path": 1, "specialist_checks": 1}
LEAST_LABELS, LABEL_CHARS, LEAST_SCORE, LEAST_FAMILIES = 2, 4000, 5, 2
#: Site types: weights of their words; the least similarity that counts.
CENTROIDS = {
    "ecommerce_retail": {"shop": 0.5, "cart": 0.4, "product": 0.3, "price": 0.3, "shipping": 0.2, "return": 0.2, "store": 0.2, "buy": 0.3, "apparel": 0.2, "coffee": 0.1},
    "saas_developer": {"api": 0.5, "docs": 0.4, "platform": 0.3, "pricing": 0.3, "cloud": 0.2, "software": 0.2, "developer": 0.3, "login": 0.2, "dashboard": 0.2},
    "media_content": {"news": 0.5, "article": 0.4, "author": 0.3, "read": 0.3, "publish": 0.2, "journal": 0.2, "magazine": 0.2, "blog": 0.3},
    "service_consulting": {"consulting": 0.5, "services": 0.4, "case": 0.3, "study": 0.3, "team": 0.2, "contact": 0.2, "portfolio": 0.3, "expertise": 0.2},
}
LEAST_SIMILARITY, ANY_TYPE = 0.01, "general_business"


def _is_schema_of(category: str):
    pattern = "|".join(x.lower() for x in SCHEMAS[category])
    return lambda t: F.lower(t).rlike(pattern)


def page_evidence(path: Column, content: Column, types: Column, page_type: Column) -> Column:
    """A page's evidence: (category, family, points) of all categories in one array."""
    low, out = F.lower(content), []
    for category in CATEGORIES:
        labels = sum((F.contains(low, F.lit(x)).cast("int") for x in LABELS[category]), F.lit(0))
        schema = F.size(F.filter(types, _is_schema_of(category)))
        points = {
            "url_path": path.rlike("|".join(PATHS[category])).cast("int"), "label_cues": (labels >= LEAST_LABELS).cast("int"), "schema_org": schema,
            "inventory_type": F.coalesce(page_type.isin(PAGE_TYPES.get(category, [])).cast("int"), F.lit(0)) if category in PAGE_TYPES else F.lit(0),
        }
        out += [F.struct(F.lit(category).alias("category"), F.lit(family).alias("family"), (n * POINTS[family]).cast("int").alias("points")) for family, n in points.items()]
    return F.filter(F.array(*out), lambda x: x["points"] > 0)


def check_item(check_id: Column) -> Column:
    """What a finding of this check says of its site: (category, family, points), null if nothing."""
    category = F.coalesce(*(F.when(check_id.startswith(p), c) for c, p in CHECK_PREFIXES.items()))
    return F.when(category.isNotNull(), F.struct(category.alias("category"), F.lit("specialist_checks").alias("family"), F.lit(POINTS["specialist_checks"]).alias("points")))


def check_evidence(findings: DataFrame) -> DataFrame:
    """site, category, family and points of (site, check_id) findings."""
    return findings.select("site", check_item(F.col("check_id")).alias("x")).where("x is not null").select("site", "x.*")


def archetypes(sites: DataFrame | None, evidence: DataFrame) -> DataFrame:
    """site, primary, secondary, confidence, families: a site has ten categories at most, so nothing grows with its pages.

    Without ``sites`` they are those of the evidence; a null category stands for a page that has none.
    """
    order = F.coalesce(*(F.when(F.col("category") == c, k) for k, c in enumerate(CATEGORIES)))
    scored = evidence.groupBy("site", "category").agg(F.sum("points").alias("score"), F.array_sort(F.collect_set("family")).alias("families"))
    good = F.col("category").isNotNull() & (F.col("score") >= LEAST_SCORE) & (F.size("families") >= LEAST_FAMILIES)
    ranked = scored.groupBy("site").agg(F.array_sort(F.collect_list(F.when(good, F.struct((-F.col("score")).alias("minus"), order.alias("place"), "category", "families")))).alias("r"))
    first = F.try_element_at("r", F.lit(1))
    out = ranked if sites is None else sites.join(ranked, "site", "left")
    high = (first["minus"] <= -10) & (F.size(first["families"]) >= 3)
    return out.select(
        "site", F.coalesce(first["category"], F.lit("GENERIC")).alias("primary"), F.coalesce(F.array_join(F.slice("r", 2, 2)["category"], ","), F.lit("")).alias("secondary"),
        F.when(first.isNull(), "low").when(high, "high").otherwise("medium").alias("confidence"), F.coalesce(F.array_join(first["families"], ","), F.lit("")).alias("families"),
    )


def site_types(terms: DataFrame) -> DataFrame:
    """site, kind, score of (site, word, n): the most similar centroid; of equal ones the first."""
    weights = {k: F.create_map(*[F.lit(v) for pair in ws.items() for v in pair]) for k, ws in CENTROIDS.items()}
    n = F.col("n").cast("double")
    dots = [F.sum(n * F.coalesce(F.try_element_at(m, F.col("word")), F.lit(0.0))).alias(k) for k, m in weights.items()]
    s = terms.groupBy("site").agg(F.sqrt(F.sum(n * n)).alias("norm"), *dots)
    scores = [F.struct((-F.bround(F.col(k) / (F.col("norm") * sum(x * x for x in ws.values()) ** 0.5), 6)).alias("minus"), F.lit(i).alias("place"), F.lit(k).alias("kind")) for i, (k, ws) in enumerate(CENTROIDS.items())]
    best = F.try_element_at(F.array_sort(F.filter(F.array(*scores), lambda x: -x["minus"] > LEAST_SIMILARITY)), F.lit(1))
    return s.select("site", F.coalesce(best["kind"], F.lit(ANY_TYPE)).alias("kind"), F.coalesce(-best["minus"], F.lit(0.0)).alias("score"))
