"""Comments as they arrive, sent off as one request when it has been quiet.

Arrival means the clock of the job and not a time in the data: state keeps what
waits, every arrival starts the quiet time anew, and its end flushes one batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelloom.sources.requests import COMMENT_FIELD, ID_FIELD, REQUEST_FIELD

QUIET_MS = 3000  # fixed value: quiet time before a batch of comments is sent off
MOST = 10_000  # comments that wait for quiet; more are sent off at once


def _body(ids: list[str], comments: list[str]) -> str:
    items = [{ID_FIELD: i, COMMENT_FIELD: c} for i, c in zip(ids, comments)]
    return json.dumps({REQUEST_FIELD: items}, ensure_ascii=False)


def debounced_requests(stream: DataFrame, key: str = "page", row_id: str = "id", comment: str = "comment",
                       quiet_ms: int = QUIET_MS, most: int = MOST) -> DataFrame:
    """(key, body, n) from (key, id, comment): a request for all that came before ``quiet_ms`` without arrivals.

    An id that waits already is not taken again.  A null id or comment is left
    out.  A key that never falls quiet is sent off whenever ``most`` wait, so
    state stays bounded.  The output is a stream of bodies for ``score_requests``.
    """
    def pages(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, comments = state.get if state.exists else ([], [])
        ids, comments = list(ids), list(comments)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "body": [_body(ids, comments)], "n": [len(ids)]})
            return
        waiting, sent = set(ids), []
        for rows in batches:
            for i, c in zip(rows[row_id], rows[comment]):
                if i is None or c is None or i in waiting:
                    continue
                waiting.add(i)
                ids.append(i)
                comments.append(c)
                if len(ids) >= most:
                    sent.append((_body(ids, comments), len(ids)))
                    ids, comments, waiting = [], [], set()
        if ids:
            state.update((ids, comments))
            state.setTimeoutDuration(quiet_ms)
        elif state.exists:
            state.remove()
        if sent:
            yield pd.DataFrame({key: [keys[0]] * len(sent), "body": [b for b, _ in sent], "n": [n for _, n in sent]})

    rows = stream.select(F.col(key).cast("string").alias(key), F.col(row_id).cast("string").alias(row_id),
                         F.col(comment).cast("string").alias(comment))
    return rows.groupBy(key).applyInPandasWithState(
        pages, f"`{key}` string, body string, n long", "ids array<string>, comments array<string>", "append",
        GroupStateTimeout.ProcessingTimeTimeout)
