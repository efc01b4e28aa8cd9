"""The notice record and its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text columns of a notice; missing is the empty string.
TEXT = (
    "job_id title url source department organization state category post_type year vacancy qualification salary age_limit "
    "application_fee selection_process exam_date application_start_date last_date notification_date publish_date scraped_at "
    "apply_link notification_pdf official_website admit_card_url result_url answer_key_url syllabus_url description content "
    "summary notification_text status ai_model official_notification_pdf posted_date html_file"
).split()
NOTICE = T.StructType(
    [T.StructField(k, T.StringType()) for k in TEXT]
    + [T.StructField(k, T.ArrayType(T.StringType())) for k in ("tags", "keywords")]
    + [T.StructField(k, T.BooleanType()) for k in ("is_valid_post", "is_expired", "ai_generated")]
    + [T.StructField("priority", T.IntegerType()), T.StructField("ord", T.LongType())]
)
#: Defaults of a record built from a link.
DEFAULTS = {"department": "Not Mentioned", "category": "Latest Jobs"}


def conform(df: DataFrame) -> DataFrame:
    """Exactly the notice columns: unknown ones go, missing ones get defaults, null text is empty."""
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        default = {T.StringType(): DEFAULTS.get(field.name, ""), T.IntegerType(): 0, T.LongType(): 0, T.BooleanType(): False}.get(field.dataType)
        if field.name not in have:
            return (F.array() if default is None else F.lit(default)).cast(field.dataType).alias(field.name)
        value = F.col(field.name).cast(field.dataType)
        return (value if default is None else F.coalesce(value, F.lit(default if field.name in DEFAULTS else {True: ""}.get(isinstance(default, str), default)))).alias(field.name)

    return df.select(*map(column, NOTICE.fields))
