"""Bronze records that cannot become events, told apart from those that can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import event_day, try_event_time
from tallyhouse.schemas import BRONZE_EVENT, CORRUPT, EVENT_DAY, FLAT_COLUMNS
from tallyhouse.session import require_utc

NOT_JSON = "not JSON of the declared types"
NOT_A_TIME = "event_timestamp is no time"
QUARANTINED = "quarantined"


def sorted_out(bronze: DataFrame) -> DataFrame:
    """Events and quarantined records in one frame, so that bronze is read once.

    An event has the silver columns and the day it occurred. A quarantined record has a
    reason, its text, and the day of the folder it lay in. A missing time is no reason: such
    an event is kept, as it is elsewhere.
    """
    require_utc(bronze.sparkSession)
    text, at = F.col("event_timestamp"), try_event_time(F.col("event_timestamp"))
    reason = F.when(F.col(CORRUPT.name).isNotNull(), NOT_JSON).when(
        text.isNotNull() & at.isNull(), NOT_A_TIME
    )
    record = F.coalesce(CORRUPT.name, F.to_json(F.struct(*BRONZE_EVENT.fieldNames())))
    bad = reason.isNotNull()
    columns = [
        (at if c.name == "event_timestamp" else F.col(c.path)).alias(c.name) for c in FLAT_COLUMNS
    ]
    return bronze.select(
        *columns,
        reason.alias("reason"),
        F.when(bad, record).alias("record"),
        bad.alias(QUARANTINED),
        F.when(bad, F.col(EVENT_DAY.name)).otherwise(event_day(at)).alias(EVENT_DAY.name),
    )
