"""URL filters: a temporal join of captures with dated blocklists.

List entries add or remove a domain on a day. The entries of a list and domain become validity
intervals [added, removed); a capture is evaluated as of its fetch day against the intervals of its
host and of the domains above it. Hosts are evaluated once each, whatever their number of captures,
and captures meet their host's intervals in a join that splits hot hosts.

Defined cases
* null urls, or urls without a host: no host, nothing active, not blocked.
* null fetch days: nothing is active. Null ids and repeated rows: each row comes back.
* entries with a null list, domain, day or action, or another action than 'add' and 'remove', are left out.
* ties: of entries of one list, domain and day an 'add' wins; repeated adds or removes change nothing.
* empty tables: nothing is active, or an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, spread_join

#: A stated list: (list, domain, day, action).
ENTRIES = (
    ("spam", "cheap-pills.example.com", "2024-02-01", "add"),
    ("spam", "cheap-pills.example.com", "2024-06-15", "remove"),
    ("spam", "cheap-pills.example.com", "2024-09-01", "add"),
    ("adult", "adult-x.example.net", "2024-01-10", "add"),
    ("adult", "adult-x.example.net", "2024-04-01", "add"),
    ("adult", "adult-x.example.net", "2024-11-30", "remove"),
    ("malware", "tionsh.example.net", "2024-05-01", "add"),
    ("malware", "tionsh.example.net", "2024-05-20", "remove"),
    ("malware", "ththat.example.net", "2024-03-05", "remove"),
    ("malware", "ththat.example.net", "2024-03-05", "add"),
    ("spam", "tionble.example.com", "2024-08-10", "add"),
    ("phishing", "m.ththth.example.net", "2024-01-01", "add"),
    ("phishing", "m.ththth.example.net", "2024-12-01", "remove"),
    ("outage", "example.org", "2024-07-01", "add"),
    ("outage", "example.org", "2024-07-08", "remove"),
)
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and final dot; null if it has none."""
    netloc = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, start, until) of the times that entries (list, domain, day, action) are in force."""
    known = entries.filter(F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("domain").isNotNull() & F.col("day").isNotNull())
    daily = known.groupBy("list", F.lower("domain").alias("domain"), F.col("day").cast("date").alias("day")).agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    w = W.partitionBy("list", "domain").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).filter("on != was")
    spans = changes.withColumn("until", F.coalesce(F.lead("day").over(w), F.lit(FOREVER).cast("date")))
    return spans.filter("on = 1").select("list", "domain", F.col("day").alias("start"), "until")


def _domains(host: Column) -> Column:
    """The host and the domains above it, of two labels at least unless the host has one."""
    labels = F.split(host, "[.]")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_on) to page_id, host, fetched_on, n_lists, lists, domain, blocked.

    lists: names of the lists in force, sorted, comma-joined; domain: the longest listed one.
    """
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched_on").cast("date").alias("fetched_on"))
    hosts = rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("__n"))
    above = hosts.select("host", F.explode(_domains(F.col("host"))).alias("domain"))
    # a listed domain may have very many hosts below it: its spans are one row, which its hosts meet in parts
    spans = intervals(entries).groupBy("domain").agg(F.collect_list(F.struct("list", "domain", "start", "until")).alias("__spans"))
    spans = cut(spans.join(above.groupBy("domain").agg(F.count("*").alias("__hosts")), "domain"))
    listed = spread_join(above, spans, ["domain"], "__hosts", ["host"]).groupBy("host").agg(F.flatten(F.collect_list("__spans")).alias("__spans"))
    known = cut(hosts.join(listed, "host", "left"))
    met = spread_join(rows.filter("host is not null"), known, ["host"], "__n", ["page_id", "fetched_on"])
    none = rows.filter("host is null").withColumn("__spans", F.lit(None).cast(met.schema["__spans"].dataType))
    every = met.select(*none.columns).unionByName(none)
    day = F.col("fetched_on")
    force = F.coalesce(F.filter("__spans", lambda s: (s["start"] <= day) & (day < s["until"])), F.array().cast(met.schema["__spans"].dataType))
    every = every.withColumn("__force", force)
    lists = F.array_sort(F.array_distinct(F.transform("__force", lambda s: s["list"])))
    longest = F.array_max(F.transform("__force", lambda s: F.struct(F.char_length(s["domain"]).alias("n"), s["domain"].alias("domain"))))
    return every.select(
        "page_id", "host", "fetched_on", F.size(lists).cast("long").alias("n_lists"), F.array_join(lists, ",").alias("lists"),
        longest["domain"].alias("domain"), (F.size("__force") > 0).alias("blocked"),
    )


def stated_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTRIES), "list string, domain string, day string, action string")


LISTS = ("spam", "adult", "malware")


def derived_entries(captures: DataFrame) -> DataFrame:
    """A list that grows with the captures (page_id, url), as the synthetic tables have none: hosts or the domains above them, added on a day and most of them removed again."""
    hosts = captures.select("page_id", host_of(F.col("url")).alias("host")).filter("host is not null").groupBy("host").agg(F.min("page_id").alias("k"))
    k, day = F.col("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") * 13 % 300).cast("int"))
    domain = F.when((k % 3 == 0) & F.col("host").rlike(r"^[^.]+\.[^.]+\."), F.regexp_replace("host", r"^[^.]+\.", "")).otherwise(F.col("host"))
    listed = hosts.filter(k % 4 != 1).select(F.element_at(F.array(*map(F.lit, LISTS)), (k % 3 + 1).cast("int")).alias("list"), domain.alias("domain"), day.alias("added"), k.alias("k"))
    each = F.array(F.struct(F.col("added").alias("day"), F.lit("add").alias("action")), F.struct(F.date_add("added", (20 + k % 90).cast("int")).alias("day"), F.when(k % 5 != 0, "remove").alias("action")))
    return listed.select("list", "domain", F.explode(each).alias("e")).select("list", "domain", F.col("e.day").cast("string").alias("day"), "e.action")


def fetch_day(page_id: Column) -> Column:
    """The fetch day of a page of the synthetic table, which has none: spread over 2024 by its id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), ((page_id * 37) % 366).cast("int"))


def oracle() -> str:
    values = ", ".join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in ENTRIES)
    host = "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\\.$', ''), '')"
    return f"""
    WITH stated(list, domain, day, action) AS (VALUES {values}),
    hosts AS (SELECT {host} AS host, min(page_id) AS k FROM pages GROUP BY 1),
    listed AS (
        SELECT CASE k % 3 WHEN 0 THEN 'spam' WHEN 1 THEN 'adult' ELSE 'malware' END AS list, k, DATE '2024-01-01' + CAST(k * 13 % 300 AS INTEGER) AS added,
            CASE WHEN k % 3 = 0 AND regexp_matches(host, '^[^.]+\\.[^.]+\\.') THEN regexp_replace(host, '^[^.]+\\.', '') ELSE host END AS domain
        FROM hosts WHERE host IS NOT NULL AND k % 4 <> 1
    ),
    entries AS (
        SELECT * FROM stated UNION ALL SELECT list, domain, added, 'add' FROM listed
        UNION ALL SELECT list, domain, added + CAST(20 + k % 90 AS INTEGER), 'remove' FROM listed WHERE k % 5 <> 0
    ),
    daily AS (SELECT list, domain, day, max(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS on_ FROM entries GROUP BY ALL),
    changes AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY list, domain ORDER BY day), 0) AS was FROM daily),
    spans AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY list, domain ORDER BY day), DATE '{FOREVER}') AS until FROM changes WHERE on_ <> was),
    captures AS (
        SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_on,
            {host} AS host
        FROM pages
    ),
    force AS (
        SELECT c.page_id, s.list, s.domain FROM captures c JOIN spans s
        ON s.on_ = 1 AND (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND s.day <= c.fetched_on AND c.fetched_on < s.until
    ),
    found AS (
        SELECT page_id, count(DISTINCT list) AS n_lists, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
            arg_max(domain, (length(domain), domain)) AS domain FROM force GROUP BY page_id
    )
    SELECT c.page_id, c.host, c.fetched_on, CAST(coalesce(f.n_lists, 0) AS BIGINT) AS n_lists, coalesce(f.lists, '') AS lists,
        f.domain, f.page_id IS NOT NULL AS blocked
    FROM captures c LEFT JOIN found f USING (page_id)
    """
