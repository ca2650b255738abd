"""Bulk exports: one parallel, ordered write each; no paging, nothing through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Columns of the published table, in order.
EXPORT_COLUMNS = {
    "id": "id", "row_number": "rowNumber", "date": "transactionDate", "type": "transactionType",
    "description": "descriptionRaw", "ticker": "ticker", "company_name": "companyName",
    "sector": "sector", "band": "amountBand", "amount_min": "amountMin", "amount_max": "amountMax",
    "notification_late": "notificationLate", "filing_id": "filingId", "filing_date": "filingDate",
    "filing_url": "sourceUrl",
}


def export_rows(view: DataFrame) -> DataFrame:
    """The published projection in date order; range-partitioned, so files are in order too."""
    rows = view.select(*EXPORT_COLUMNS).orderBy("date", "id")
    return rows.withColumnsRenamed(EXPORT_COLUMNS)


def export_csv(view: DataFrame, path: str) -> str:
    writer = export_rows(view).write.mode("overwrite")
    writer.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').option(
        "quoteAll", False
    ).option("dateFormat", "yyyy-MM-dd").csv(path)
    return path


def export_ndjson(view: DataFrame, path: str) -> str:
    export_rows(view).write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").option("ignoreNullFields", False).json(path)
    return path
