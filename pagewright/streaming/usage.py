"""Token estimates on a stream of requests: each route's sums so far are the state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.decide import CHARS_PER_TOKEN


def estimates(requests: DataFrame) -> DataFrame:
    """(request, route, chars, estimate) of a stream of requests (request, route, at, chars, tokens).

    Within a trigger, requests are taken in the order of `at`, then request; those without tokens teach nothing. The state of a
    route is two sums, whatever its past.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chars, tokens = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "request"])
        out = []
        for r in rows.itertuples():
            guess = None if pd.isna(r.chars) else math.ceil(r.chars * tokens / chars if chars > 0 and tokens > 0 else r.chars / CHARS_PER_TOKEN)
            out.append((r.request, key[0], None if guess is None else int(r.chars), guess))
            if not (pd.isna(r.tokens) or pd.isna(r.chars)):
                chars, tokens = chars + int(r.chars), tokens + int(r.tokens)
        state.update((chars, tokens))
        yield pd.DataFrame(out, columns=["request", "route", "chars", "estimate"]).astype({"chars": "Int64", "estimate": "Int64"})

    kept = requests.select("request", "route", "at", "chars", "tokens")
    return kept.groupBy("route").applyInPandasWithState(step, "request long, route string, chars long, estimate long", "chars long, tokens long", "append", GroupStateTimeout.NoTimeout)
