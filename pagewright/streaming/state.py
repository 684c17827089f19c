"""Custom state: site chrome that is found once, when a site's sixth page arrives, and holds from then on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.assemble import CHROME_PAGES, CHROME_SHARE


def stream_chrome(lines: DataFrame, pages: int = CHROME_PAGES, share: float = CHROME_SHARE) -> DataFrame:
    """(site, page_id, key, chrome) of a stream of block keys (site, page_id, key): pages that come before a site's chrome
    is known pass unmarked, as do pages of small sites. The state of a site is bounded by its first pages."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, seen, chrome = state.get if state.exists else (False, [], [])
        counts = [list(x) for x in seen]
        for f in frames:
            known = set(chrome)
            out = f[["page_id", "key"]].copy()
            out.insert(0, "site", key[0])
            out["chrome"] = out.key.isin(known) if done else False
            yield out
            if not done:
                counts += [[str(p), *sorted(set(k))] for p, k in f.groupby("page_id").key]
                merged: dict[str, set] = {}
                for p, *keys in counts:
                    merged.setdefault(p, set()).update(keys)
                counts = [[p, *sorted(k)] for p, k in sorted(merged.items())]
                if len(merged) >= pages:
                    every = pd.Series([k for ks in merged.values() for k in ks if k]).value_counts()
                    chrome = sorted(every[every >= max(2, int(len(merged) * share + 1e-9))].index)
                    done, counts = True, []
        state.update((done, counts, chrome))

    return lines.groupBy("site").applyInPandasWithState(step, "site string, page_id long, key string, chrome boolean", "done boolean, seen array<array<string>>, chrome array<string>", "append", GroupStateTimeout.NoTimeout)
