"""Reading and writing: stored pages, CSV folders, samples, previews."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators import activity, cleaning
from footfall.plans import bindings
from footfall.plans.registry import query
from footfall.session import materialise, remove_scratch, scratch_path
from footfall.sources import csv_files, stored_pages
from footfall.sources.tables import read_table

RUN_DAY = "2024-03-06"

LINK_PATTERNS = {
    "href": r'<li><a href="([^"]*)">',
    "label": r'<li><a href="[^"]*">([^<]*)</a>',
}
COUNTER_PATTERNS = {"track": r"track\(([^)]*)\)", "ad": r"<!-- ad ([^ ]*) -->"}
PAGE_PATTERNS = {
    "lang": r'<html lang="([^"]*)"',
    "title": r"<title>([^<]*)</title>",
    "heading": r"<h1>([^<]*)</h1>",
    "counter": r"(track\([^)]*\))",
}

RECORDS_SQL = r"""
lists AS (
  SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
         regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS labels
  FROM pages),
spots AS (
  SELECT page_id, hrefs, labels, unnest(range(1, least(len(hrefs), len(labels)) + 1)) AS i FROM lists),
records AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS position, hrefs[i] AS href, labels[i] AS label FROM spots)"""


@query("page_records", f"WITH {RECORDS_SQL} SELECT * FROM records")
def page_records(spark, folder):
    pages = read_table(spark, "pages", folder)
    return stored_pages.repeated_records(pages, LINK_PATTERNS, ["page_id"])


@query(
    "page_record_counts",
    f"WITH {RECORDS_SQL} SELECT page_id, count(*) AS records FROM records GROUP BY page_id",
)
def page_record_counts(spark, folder):
    return stored_pages.record_counts(page_records(spark, folder), ["page_id"])


@query(
    "page_counters",
    r"""WITH lists AS (
  SELECT page_id, regexp_extract_all(html, 'track\(([^)]*)\)', 1) AS tracks,
         regexp_extract_all(html, '<!-- ad ([^ ]*) -->', 1) AS ads
  FROM pages),
spots AS (
  SELECT page_id, tracks, ads, unnest(range(1, least(len(tracks), len(ads)) + 1)) AS i FROM lists),
records AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS position, try_cast(tracks[i] AS INTEGER) AS track,
         try_cast(ads[i] AS INTEGER) AS ad FROM spots)
SELECT * FROM records WHERE track IS NOT NULL AND ad IS NOT NULL""",
)
def page_counters(spark, folder):
    pages = read_table(spark, "pages", folder)
    return stored_pages.repeated_records(
        pages, COUNTER_PATTERNS, ["page_id"], integer_fields=("track", "ad")
    )


@query(
    "page_link_records",
    r"""WITH blocks AS (
  SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
         nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
         regexp_extract_all(html, '<li>[^!]*?</li>') AS found
  FROM pages),
spots AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM blocks)
SELECT page_id, lang, title, CAST(i - 1 AS INTEGER) AS position,
       nullif(regexp_extract(found[i], '<a href="([^"]*)"', 1), '') AS href,
       nullif(regexp_extract(found[i], '>([^<>]+)</a>', 1), '') AS label
FROM spots WHERE nullif(regexp_extract(found[i], '<a href="([^"]*)"', 1), '') IS NOT NULL""",
)
def page_link_records(spark, folder):
    # Page-level fields stand on every record of the page.
    return stored_pages.block_records(
        read_table(spark, "pages", folder),
        "<li>[^!]*?</li>",
        {"href": '<a href="([^"]*)"', "label": ">([^<>]+)</a>"},
        ["page_id"],
        {"lang": PAGE_PATTERNS["lang"], "title": PAGE_PATTERNS["title"]},
        required=("href",),
    )


@query(
    "page_number_records",
    r"""WITH blocks AS (
  SELECT page_id, regexp_extract_all(html, '<p>[^<]*</p>') AS found FROM pages),
spots AS (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM blocks),
fields AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS position,
         regexp_extract(found[i], '<p>([^ <]*)', 1) AS opening,
         try_cast(nullif(regexp_extract(found[i], '([0-9][0-9,-]*)', 1), '') AS INTEGER) AS number
  FROM spots)
SELECT page_id, position, opening, number FROM fields WHERE number IS NOT NULL AND opening <> ''""",
)
def page_number_records(spark, folder):
    # Most paragraphs hold no number, and some one that is no integer: all dropped.
    return stored_pages.block_records(
        read_table(spark, "pages", folder),
        "<p>[^<]*</p>",
        {"opening": "<p>([^ <]*)", "number": "([0-9][0-9,-]*)"},
        ["page_id"],
        required=("opening",),
        integer_fields=("number",),
    )


@query("catalog_dau", "SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS dau FROM events GROUP BY 1")
def catalog_dau(spark, folder):
    # The same operator on a name of the session's catalog instead of a folder.
    read_table(spark, "events", folder).createOrReplaceTempView("footfall_events")
    return activity.daily_active(read_table(spark, "footfall_events")).select("date", "dau")


@query(
    "page_engagement",
    rf"""SELECT page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
       nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
       nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading,
       try_cast(regexp_replace(regexp_extract(html, '(track\([^)]*\))', 1), '[^0-9]', '', 'g') AS INTEGER)
         AS counter,
       DATE '{RUN_DAY}' AS down_at
FROM pages""",
)
def page_engagement(spark, folder):
    pages = read_table(spark, "pages", folder)
    return stored_pages.page_fields(
        pages, PAGE_PATTERNS, ["page_id"], RUN_DAY, digit_fields=("counter",)
    )


FILE_LAYOUT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("comment_date", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("comment_like", T.LongType()),
        T.StructField("chapter", T.LongType()),
    ]
)


@query("csv_roundtrip", f"WITH {bindings.RAW_COMMENTS_SQL} SELECT * FROM raw_comments")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "comments-csv")
    raw = bindings.raw_comments(spark, folder).select(*FILE_LAYOUT.names)
    csv_files.write_csv_folder(raw, path)
    rows = materialise(csv_files.read_csv_folder(spark, path, FILE_LAYOUT))
    remove_scratch(spark, path)
    return rows


@query(
    "csv_union_drift",
    f"""WITH {bindings.RAW_COMMENTS_SQL}
SELECT event_id, user_id, comment_date, content,
       CASE WHEN content IS NOT NULL AND content <> 'click' THEN comment_like END AS comment_like,
       CASE WHEN content IS NULL THEN chapter END AS chapter,
       CASE WHEN content = 'purchase' THEN chapter::VARCHAR END AS seen,
       CASE WHEN content = 'click' THEN concat(comment_like, '|', chapter) END AS surplus
FROM raw_comments""",
)
def csv_union_drift(spark, folder):
    # Four file families of one folder: moderated rows carry no likes, most others no
    # chapter, and columns come in another order. Purchases name theirs by a header
    # cell with a line break; clicks have two cells more than their header.
    path = scratch_path(spark, "drift csv 댓글")
    raw = bindings.raw_comments(spark, folder)
    kind = F.col("content")
    common = ["event_id", "user_id", "comment_date", "content"]
    clicks = F.concat_ws(",", *common, "comment_like", "chapter").alias(",".join(common))
    csv_files.write_csv_folder(
        raw.filter(~kind.isin("purchase", "click")).select(*common, "comment_like"), f"{path}/live"
    )
    csv_files.write_csv_folder(
        raw.filter(kind.isNull()).select("chapter", "comment_date", "content", "event_id", "user_id"),
        f"{path}/moderated",
    )
    csv_files.write_csv_folder(
        raw.filter(kind == "purchase").select(F.col("chapter").alias("seen\nat"), *common, "comment_like"),
        f"{path}/paid",
    )
    raw.filter(kind == "click").select(clicks).write.csv(
        f"{path}/clicks", header=True, sep="\u0001", quote="\u0000"
    )
    both = csv_files.read_csv_union(spark, path, FILE_LAYOUT, multiline=True)
    both = materialise(
        both.withColumnRenamed("seen\nat", "seen")
        .withColumn("surplus", F.array_join(csv_files.SURPLUS, "|"))
        .drop(csv_files.SURPLUS)
    )
    remove_scratch(spark, path)
    return both


@query(
    "table_preview",
    "SELECT event_id, user_id, ts FROM events ORDER BY event_id LIMIT 5",
)
def table_preview(spark, folder):
    return cleaning.preview(
        bindings.events(spark, folder), ["event_id", "user_id", "ts"], 5, ["event_id"]
    )


@query("sample_rows", "SELECT * FROM events ORDER BY md5(concat('11|', event_id)), event_id LIMIT 5")
def sample_rows(spark, folder):
    return cleaning.reproducible_sample(bindings.events(spark, folder), 5, ["event_id"], seed=11)
