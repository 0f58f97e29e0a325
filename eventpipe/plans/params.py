"""Parameters of the registered queries (run time, selectors, paging), not data."""

RUN_TS = "2024-01-01 00:00:00"  # the daily run the messages belong to
RUN_ID = "2024-01-01"
EXTRACT_TOPIC = "event-extract"  # fixed value: topic names of the reference
SCRAPE_TOPIC = "venue-scrape"
MESSAGE_VENUES = ("click", "purchase", "view")  # registry of the message queries: three of the five event types
OBJECT_BASE_URL = "https://objects.example.com/"
LIST_LIMIT = 25
LIST_CURSOR = "event-5"
LIST_PREFIX = "event-1"
CATEGORY = "household"
RETRY_AFTER_S = 60  # fixed value: retry interval of both topics
