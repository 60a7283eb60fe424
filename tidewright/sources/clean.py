"""Cleaning and reshaping of what the sources deliver."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holdout(bars: DataFrame, n: int, key: str = "code", ts: str = "ts") -> DataFrame:
    """Without the last ``n`` bars of each code."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    return bars.withColumn("_rn", last).where(F.col("_rn") > n).drop("_rn")


def date_span(bars: DataFrame, start=None, end=None, periods: int = 1, freq: str = "D", ts: str = "ts") -> DataFrame:
    """Bars in [start, end]; a missing start is ``periods`` days, weeks or months before the end."""
    end = F.lit(end).cast("date")
    back = {"D": F.date_sub(end, periods), "W": F.date_sub(end, 7 * periods), "M": F.add_months(end, -periods)}
    start = F.lit(start).cast("date") if start is not None else back[freq]
    return bars.where(F.col(ts).between(start, end))


def restrict(bars: DataFrame, universe: DataFrame, key: str = "code") -> DataFrame:
    """Bars of the listed codes."""
    return bars.join(universe.select(key).distinct(), key, "left_semi")


def listing_filter(listing: DataFrame, column: str, value: str) -> DataFrame:
    return listing.where(F.col(column) == value)


def html_values(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """One row per match of the pattern's group 1: ``page_id, value``."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("value"))


def html_attribute(pages: DataFrame, tag: str, attribute: str, containing: str, base: str, html: str = "html") -> DataFrame:
    """First value of the attribute that contains a text, after the base address: ``page_id, url``."""
    pattern = rf'<{tag}\b[^>]*?\b{attribute}="([^"]*)"'
    values = F.filter(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)), lambda v: v.contains(containing))
    return pages.select("page_id", F.concat(F.lit(base), F.get(values, F.lit(0))).alias("url"))


class _PriceTable(HTMLParser):
    """Rows of the first table with the wanted attribute value."""

    def __init__(self, marker: str):
        super().__init__()
        self.marker, self.state, self.rows, self.cell = marker, "before", [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and self.state == "before" and any(self.marker in (v or "") for _, v in attrs):
            self.state = "in"
        elif self.state == "in" and tag == "tr":
            self.rows.append([])
        elif self.state == "in" and tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None
        elif tag == "table" and self.state == "in":
            self.state = "after"


def html_table(pages: DataFrame, columns: list[str], marker: str = "historical-prices") -> DataFrame:
    """Rows of each page's price table as strings, thousands separators removed.

    The heading names the columns (``*`` removed, blanks to ``_``); rows of
    another width, such as the footnote, are left out.
    """

    def run(frames):
        for frame in frames:
            out = []
            for page_id, html in zip(frame["page_id"], frame["html"]):
                parser = _PriceTable(marker)
                parser.feed(html or "")
                if not parser.rows:
                    continue
                head = [c.replace("*", "").strip().replace(" ", "_") for c in parser.rows[0]]
                for cells in parser.rows[1:]:
                    if len(cells) == len(head):
                        row = dict(zip(head, (c.replace(",", "") if k else c for k, c in enumerate(cells))))
                        out.append([page_id, *[row.get(c) for c in columns]])
            yield pd.DataFrame(out, columns=["page_id", *columns])

    schema = "page_id long, " + ", ".join(f"`{c}` string" for c in columns)
    return pages.select("page_id", "html").mapInPandas(run, schema)


def next_known(column: str, key: str, ts: str) -> Column:
    """The value, or the next one that is not missing."""
    ahead = Window.partitionBy(key).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    return F.first(column, ignorenulls=True).over(ahead)


def last_known(column: str, key: str, ts: str) -> Column:
    back = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(column, ignorenulls=True).over(back)


def clean_scraped(rows: DataFrame, columns: list[str], key: str = "name", date: str = "date") -> DataFrame:
    """``Oct 12, 2018`` to dates; ``-`` to the next known value, column by column."""
    rows = rows.withColumn(date, F.to_date(date, "MMM d, yyyy"))
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("-")).cast("double") for c in columns})
    return rows.withColumns({c: next_known(c, key, date) for c in columns})


def backfill(rows: DataFrame, columns: list[str], key: str = "name", ts: str = "ts") -> DataFrame:
    return rows.withColumns({c: next_known(c, key, ts) for c in columns})


def to_series(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Each column a named series: ``ids..., name, close``."""
    return wide.unpivot(ids, columns, "name", "close")


CANDLES = "candles array<struct<time string, mid struct<o string, h string, l string, c string>>>"


def flatten_candles(documents: DataFrame, column: str = "json", end: str | None = None) -> DataFrame:
    """Rows of nested candle documents: ``date, open, high, low, close`` beside the other columns."""
    other = [c for c in documents.columns if c != column]
    rows = documents.select(*other, F.explode(F.from_json(column, CANDLES)["candles"]).alias("x"))
    prices = {"o": "open", "h": "high", "l": "low", "c": "close"}
    rows = rows.select(
        *other, F.split("x.time", "T")[0].cast("date").alias("date"), *[F.col(f"x.mid.{a}").cast("double").alias(b) for a, b in prices.items()]
    )
    return rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows


def epoch_to_timestamp(rows: DataFrame, column: str = "time") -> DataFrame:
    return rows.withColumn("timestamp", F.timestamp_seconds(column)).drop(column)


def flatten_selection(results: DataFrame, image_prefix: str) -> DataFrame:
    """One row per selected code, scalars repeated, with the address of its chart."""
    rows = results.withColumn("code", F.explode("result_code_list"))
    image = F.concat(F.lit(image_prefix), "method", F.lit("_"), "code", F.lit(".png"))
    return rows.select("code", "method", "creat_time", "data_range_start_to_compute", "data_range_end_to_compute", image.alias("image_url"))


def latest_per_method(results: DataFrame, file: str = "file") -> DataFrame:
    """Of each method the result with the last file name."""
    rows = results.groupBy("method").agg(F.max_by(F.struct("*"), file).alias("r"))
    return rows.select("r.*")


def reward_documents(rewards: DataFrame) -> DataFrame:
    """One nested document per method, for a JSON writer."""
    entry = F.struct("code", "reward_rates", "reward_rate_mean")
    return rewards.groupBy("method").agg(F.sort_array(F.collect_list(entry)).alias("reward_results"))


def head_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows: a top-n, not a cut of the work."""
    return rows.orderBy(*order).limit(n)
