"""Small HTML page tables for the tests."""


def html_pages(spark, rows, site="d.io"):
    """rows: list of (page_id, url, body_html)."""
    data = [(site, pid, url, f"<html><head></head><body>{body}</body></html>") for pid, url, body in rows]
    return spark.createDataFrame(data, "site string, page_id bigint, url string, html string")
