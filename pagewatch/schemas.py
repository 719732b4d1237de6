"""Schemas of the tables the operators read and write."""

LINKS = "array<struct<url:string,text:string>>"
LINK_CHANGES = "array<struct<url:string,text:string,old_text:string,new_text:string>>"

# Place of a URL in its source: source rank, document, block in it, row in the block.
URL_POSITION = "struct<source:int,document:string,block:bigint,row:bigint>"

URLS = f"pos {URL_POSITION}, url string"
SITEMAPS = "sitemap_url string, xml string"
FETCH_ATTEMPTS = "url string, attempt int, status_code int, content string, error string"
FETCH_RESULTS = "url string, ok boolean, status_code int, html string, error string"
SAVED_PAGES = "file_name string, html string"

# Everything the audit and the comparison need, without html and visible text; only robots files are whole.
FIELD_COLUMNS = (
    "title",
    "has_title",
    "canonical",
    "is_canonical_self_ref",
    "meta_description",
    "has_meta_description",
    "h1",
    "has_h1",
    "multiple_h1s",
    "is_robots",
    "text_length",
    "text_digest",
    "robots_text",
    "nav",
)
# Those of them that a comparison reads; the others are the audit's.
COMPARED_COLUMNS = ("title", "canonical", "h1", "is_robots", "text_length", "text_digest", "robots_text", "nav")
VERSION_KEYS = ("url", "ts_key", "id")
PAGE_VERSIONS = (
    "id bigint, url string, ts_key string, snapshot_date string, status_code int, html string,"
    " title string, has_title boolean, canonical string, is_canonical_self_ref boolean,"
    " meta_description string, has_meta_description boolean, h1 array<string>, has_h1 boolean,"
    " multiple_h1s boolean, is_robots boolean, text string, text_length int,"
    f" text_digest string, robots_text string, nav {LINKS}"
)
CHANGE_TYPE = (
    "struct<type:string,message:string,percent_diff:double,old_value:string,"
    f"new_value:string,links:{LINK_CHANGES}>"
)
ISSUE_TYPE = "struct<rule_no:int,severity:string,rule:string,message:string>"
