"""Table schemas, as DDL strings."""

# One captured search or detail page. ``body`` is HTML, or JSON for the agency's API.
# ``kind`` is 'search', 'detail' or 'detail_public' (the agency's public page).
CAPTURES = (
    "platform string, query_idx int, page_no int, kind string, url string, body string, "
    "observed_at timestamp"
)

ORDER_COLUMNS = ["platform_rank", "query_idx", "page_no", "card_pos"]

POSTINGS = (
    "job_id string, title string, company string, location string, url string, "
    "posting_date string, platform string, experience_level string, description string, "
    "summary string, platform_rank int, query_idx int, page_no int, card_pos int, "
    "observed_at timestamp"
)

# A posting as the scrape cache of the file-based tool holds it.
CACHED_POSTING = (
    "title string, company string, location string, url string, posting_date string, "
    "platform string, experience_level string, description string, summary string, job_id string"
)

LEDGER = "job_id string, url string, platform string, date_sent timestamp, run_id string"
LEDGER_RECORD = "job_id string, url string, platform string, date_sent string"

ATTEMPTS = (
    "run_id string, job_id string, model string, model_rank int, raw string, error string, "
    "job_started_at timestamp, responded_at timestamp"
)

LISTING_ITEM = (
    "struct<refnr:string,titel:string,arbeitgeber:string,"
    "aktuelleVeroeffentlichungsdatum:string,eintrittsdatum:string,"
    "arbeitsort:struct<ort:string,plz:string,land:string>>"
)
LISTING_PAYLOAD = f"struct<stellenangebote:array<{LISTING_ITEM}>,maxErgebnisse:bigint,totalCount:bigint>"

DETAIL_PAYLOAD = (
    "struct<stellenbeschreibung:string,beschreibung:string,berufserfahrung:string,"
    "qualifikationsniveau:string,"
    "stellenangebot:struct<stellenbeschreibung:string,beschreibung:string>>"
)
