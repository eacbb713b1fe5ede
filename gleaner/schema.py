"""Record shapes shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TEXT = ("id category name organizer description eligibility mode location fee prize stipend duration "
         "deadline event_date program_dates internship_dates application_link website url link "
         "status source location_mode location_label country").split()

OPPORTUNITY = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField("tags", T.ArrayType(T.StringType())),
       T.StructField("mentorship", T.BooleanType()),
       T.StructField("needs_review", T.BooleanType())])

CAPTURE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "final_url", "body", "error", "source")]
                       + [T.StructField("status", T.IntegerType()), T.StructField("tier", T.IntegerType())])

# State tables as DDL texts.
LEDGER = ("fp string, name string, category string, source string, link string, first_seen timestamp_ntz, "
          "last_checked timestamp_ntz, attempts bigint, decision string, layer string, reasons array<string>, "
          "evidence string, evidence_hash string, trust double, corroboration bigint, "
          "corrections map<string,string>, permanent boolean")

QUARANTINE = ("category string, fp string, attempts bigint, first_held timestamp_ntz, last_seen timestamp_ntz, "
              f"reasons array<string>, item {OPPORTUNITY.simpleString()}")

# JSON files use camel case.
JSON_NAMES = {"event_date": "eventDate", "program_dates": "programDates", "internship_dates": "internshipDates",
              "application_link": "applicationLink", "location_mode": "locationMode",
              "location_label": "locationLabel", "needs_review": "needsReview"}


def conform(df: DataFrame) -> DataFrame:
    """Give ``df`` exactly the opportunity columns; absent ones become null."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in OPPORTUNITY.fields])
