"""Regions of an image that come in several files: held as keyed state until all are there."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.model import ROIS

#: What has become of a region: measured now, given up as others did not come, or come after its image was measured.
READY, INCOMPLETE, LATE = "ready", "incomplete", "late"
_HELD = "texts array<string>, expected long, measured boolean"
_GIVEN = "section_id string, status string, expected long, roi string"


def gathered(rois: DataFrame, sections: DataFrame, wait_seconds: float) -> DataFrame:
    """``rois`` (a stream) with status and expected: the regions of whole images, however many files they came in.

    ``sections`` has for each image the number of its ``regions``; they leave together as ``ready`` when that many
    are there. A region that is sent again (same roi_idx) takes the place of the one before. If nothing new of an image
    comes for ``wait_seconds`` (at least one; told by the times of later batches), what is there leaves as ``incomplete``; regions that
    come within that time after their image was measured leave as ``late``. Either way the state goes, so it holds open images
    only. Images whose number is null, or that ``sections`` has not, leave with each batch as they come; regions without a
    section_id as ``incomplete``.

    Time is that of batches and not of the regions, so no region is late for the watermark; a running clock's timeout would keep a
    query that reads what is available from ending.
    """
    counted = sections.where("regions IS NOT NULL").select("section_id", F.col("regions").cast("long").alias("expected"))
    columns = ["section_id", "roi_idx", "name", "kind", "props", "rings"]
    timed = rois.select(*columns, F.current_timestamp().alias("came")).withWatermark("came", f"{max(1.0, wait_seconds)} seconds")
    sent = timed.join(counted, "section_id", "left").select("section_id", "expected", "came", F.to_json(F.struct(*columns)).alias("roi"))
    # those that nothing is known of are dealt over groups of their own, as they need not meet
    apart = F.when(F.col("expected").isNull() | F.col("section_id").isNull(), F.pmod(F.xxhash64("roi"), F.lit(1024))).otherwise(F.lit(-1))
    groups = sent.withColumn("apart", apart).groupBy("section_id", "apart")
    given = groups.applyInPandasWithState(_gather, _GIVEN, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return given.select("section_id", "status", "expected", F.from_json("roi", ROIS).alias("r")).select("section_id", *(f"r.{c}" for c in columns[1:]), "status", "expected")


def _out(section: str | None, status: str, expected: int | None, texts: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"section_id": pd.Series([section] * len(texts), dtype=object), "status": status, "expected": pd.array([expected] * len(texts), dtype="Int64"), "roi": texts})


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One image's regions, or some that nothing is known of."""
    section, apart = key
    if apart >= 0:
        for b in batches:
            yield _out(section, INCOMPLETE if section is None else READY, None, b["roi"].tolist())
        return
    texts, expected, measured = state.get if state.exists else ([], None, False)
    if state.hasTimedOut:
        state.remove()
        if not measured:
            yield _out(section, INCOMPLETE, expected, list(texts))
        return
    held, new, came = {_number(t): t for t in texts}, {}, 0
    for b in batches:
        expected, came = int(b["expected"].iloc[0]), int(b["came"].iloc[0].timestamp() * 1000)
        new |= {_number(t): t for t in b["roi"]}
    if measured:
        yield _out(section, LATE, expected, list(new.values()))
    else:
        held |= new
        if len(held) >= expected:
            yield _out(section, READY, expected, list(held.values()))
            held, measured = {}, True
    state.update((list(held.values()), expected, measured))
    state.setTimeoutTimestamp(max(came, state.getCurrentWatermarkMs()) + 1)


def _number(text: str) -> str:
    """What tells a region from the others of its image: its number, or its whole text if it has none."""
    number = json.loads(text).get("roi_idx")
    return text if number is None else str(number)
