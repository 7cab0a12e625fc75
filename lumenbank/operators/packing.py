"""Order-dependent steps that no set expression gives: packing and sequential acceptance, one small group at a time.

Groups here are areas of a cluster or candidates of a shelf, bounded by the
catalogue and by what a shelf may hold, not by the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def next_fit(areas: DataFrame, group: str, size: int) -> DataFrame:
    """(group, area, part, chunk, n): areas above ``size`` split evenly, the others packed next to each other until a chunk is full."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        out, chunk, room = [], 0, 0
        for area, n in sorted(zip(rows["area"], rows["n"])):
            if n > size:
                parts = -(-n // size)
                for p in range(parts):
                    chunk += 1
                    out.append((key[0], area, p, chunk, n // parts + (p < n % parts)))
                room = 0
            else:
                if n > room:
                    chunk, room = chunk + 1, size
                room -= n
                out.append((key[0], area, 0, chunk, n))
        return pd.DataFrame(out, columns=[group, "area", "part", "chunk", "n"])

    return areas.groupBy(group).applyInPandas(pack, f"{group} string, area string, part long, chunk long, n long")


def first_fit_decreasing(areas: DataFrame, group: str, size: int) -> DataFrame:
    """(group, area, part, bin, n): areas above ``size`` split evenly, then the largest parts first, each into the first bin with room."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rooms, out, parts = [], [], []
        for area, n in zip(rows["area"], rows["n"]):
            pieces = max(1, -(-n // size))
            parts += [(-(n // pieces + (p < n % pieces)), area, p) for p in range(pieces)]
        for n, area, p in sorted(parts):
            at = next((i for i, room in enumerate(rooms) if room >= -n), None)
            if at is None:
                rooms.append(size)
                at = len(rooms) - 1
            rooms[at] += n
            out.append((key[0], area, p, at + 1, -n))
        return pd.DataFrame(out, columns=[group, "area", "part", "bin", "n"])

    return areas.groupBy(group).applyInPandas(pack, f"{group} string, area string, part long, bin long, n long")


def accept_in_order(candidates: DataFrame, group: str, most_alike: float, depth: int) -> DataFrame:
    """(group, id, accepted, nearest): candidates in order of id against those that were accepted before them, up to ``depth``."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        shelf: list[tuple[int, frozenset]] = []
        out = []
        for i, words in sorted(zip(rows["id"], rows["words"]), key=lambda x: x[0]):
            mine = frozenset(words)
            near, who = max(((len(mine & w) / max(len(mine | w), 1), -j) for j, w in shelf), default=(0.0, 0))
            good = near < most_alike and len(shelf) < depth
            out.append((key[0], i, good, -who if shelf else None))
            if good:
                shelf.append((i, mine))
        return pd.DataFrame(out, columns=[group, "id", "accepted", "nearest"]).astype({"nearest": "Int64"})

    return candidates.groupBy(group).applyInPandas(run, f"{group} string, id long, accepted boolean, nearest long")
