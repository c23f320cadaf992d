"""Plain Python models of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def byte_ids(text: str) -> list[int]:
    return [256, *text.encode("utf-8")]


def take_budget(docs: list[tuple[int, str]], target: int) -> list[tuple[int, int, str]]:
    """``(seq, kept tokens, text)`` of one source in order."""
    kept, used = [], 0
    for seq, text in sorted(docs):
        if used >= target:
            break
        ids = byte_ids(text)
        room = target - used
        if len(ids) > room:
            text = bytes(ids[:room][1:]).decode("utf-8", "replace")
            ids = ids[:room]
        kept.append((seq, len(ids), text))
        used += len(ids)
    return kept


def shuffle(rows: list[tuple], seed: int) -> list[tuple]:
    """Rows ``(source, seq, ...)`` in shuffled order."""
    key = lambda r: hashlib.md5(f"{seed}|{r[0]}|{r[1]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (key(r), r[0], r[1]))


def pack(sizes: list[int], limit: int) -> list[int]:
    """Shard number of each document."""
    out, used, shard = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            shard, used = shard + 1, 0
        used += n
        out.append(shard)
    return out


def read_windows(stream: list[int], world: int, rank: int, block: int, count: int) -> list[list]:
    """The first ``count`` windows a rank's moving pointer reads."""
    per = len(stream) // world
    low, high = rank * per, (rank + 1) * per
    at, found = low, []
    for _ in range(count):
        if at + block + 1 > high:
            at = low
        found.append(stream[at : at + block + 1])
        at += block
    return found
