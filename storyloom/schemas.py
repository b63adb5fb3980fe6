"""Schemas of the records that stages hand on."""

SOURCE = (
    "id string, name string, publisher string, url string, tier string, region string, terms_url string, snippet_max_words int, "
    "attribution_required boolean, timeout_seconds int, default_tz string, max_entries int"
)
ENTRY = (
    "title string, link string, summary string, description string, published string, updated string, created string, "
    "date string, dc_date string"
)
FEED = "source_id string, status int, error string, entries array<struct<" + ENTRY.replace(" string", ":string") + ">>"
ARTICLE = (
    "id string, title string, snippet string, url string, source_id string, source_name string, source_tier string, "
    "publisher string, published_at timestamp, fetched_at timestamp"
)
LEDGER = "date string, event_type string, entity string, value string, cluster_id string"
ANALYSIS = (
    "headline string, hook string, gist array<string>, what_happened string, "
    "who_is_affected array<struct<group:string,effect:string>>, sectors array<struct<sector:string,direction:string,why:string>>, "
    "transmission_mechanism struct<chain:array<string>,explanation:string,time_horizon:string>, market_reaction string, "
    "bull_case struct<argument:string,depends_on:array<string>>, bear_case struct<argument:string,depends_on:array<string>>, "
    "variables_to_watch array<struct<variable:string,why_it_matters:string,when:string>>, confidence string, "
    "confidence_reason string, jargon array<struct<term:string,plain_meaning:string>>"
)
PUBLISHED = (
    "cluster_id string, analysis struct<headline:string,hook:string,gist:array<string>>, "
    "tags struct<entities:array<string>,tickers:array<string>,sectors:array<string>,macro_themes:array<string>>, "
    "sources array<struct<name:string,headline:string,url:string,published_at:string>>, published_at timestamp, "
    "updated_at timestamp, confidence string, tier string"
)
