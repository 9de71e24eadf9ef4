"""A world from outside: whole snapshots of one revision, fenced writes, and workers that answer requests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from weirlog.requests import Requests
from weirlog.types import RuleError
from weirlog.worlds import World

MOST_RELATIONS, MOST_READS, MOST_ROWS, MOST_WORKERS = 128, 16, 1000, 16


@dataclass(frozen=True)
class Snapshot:
    world: str
    generation: int
    revision: int
    relations: dict[str, list[list]]


@dataclass
class WorldClient:
    """One generation of a world. Reads are whole or fail; a write is sent once and never repeated."""

    world: World
    max_rows: int = 100_000
    max_bytes: int = 64 << 20
    generation: int = field(default=-1)

    def __post_init__(self) -> None:
        if self.generation < 0:
            self.generation = self.world.generation

    def snapshot(self, relations: Sequence[str]) -> Snapshot:
        """All rows of the relations at one revision; a change in between or too many rows are errors, never a part."""
        if len(relations) > MOST_RELATIONS or len(set(relations)) != len(relations):
            raise RuleError(f"A snapshot has at most {MOST_RELATIONS} different relations")
        revision, found = self.world.status().get("revision"), {name: [] for name in relations}
        if revision is None:
            raise RuleError(f"World {self.world.name} is {self.world.state}")
        rows = size = 0
        open_reads: dict[str, str | None] = dict.fromkeys(relations)
        while open_reads:
            asked = list(open_reads)[:MOST_READS]
            reads = [{"relation": n, "max_rows": MOST_ROWS // len(asked), "cursor": open_reads[n]} for n in asked]
            for name, page in zip(asked, self.world.read_batch(self.generation, revision, reads), strict=True):
                rows, size = rows + len(page.rows), size + page.bytes
                if rows > self.max_rows or size > self.max_bytes:
                    raise RuleError("The snapshot is beyond the client's bounds")
                found[name] += page.rows
                if page.truncated:
                    open_reads[name] = page.cursor
                else:
                    del open_reads[name]
        return Snapshot(self.world.name, self.generation, revision, found)

    def rows(self, relation: str) -> list[list]:
        return self.snapshot([relation]).relations[relation]

    def compare_apply(self, seen: Snapshot, changes: Sequence[Mapping], key: str | None = None, publish: Callable | None = None) -> dict:
        """Applies changes if the world still is as the snapshot saw it; the admission's record."""
        if (seen.world, seen.generation) != (self.world.name, self.generation):
            raise RuleError("The snapshot is of another world or generation")
        return self.world.admit(key or uuid.uuid4().hex, self.generation, seen.revision, changes, publish)


def answer(requests: Requests, call: Callable[[Mapping], str], workers: int = MOST_WORKERS) -> list[dict]:
    """Claims every pending request, calls outside code (at most 16 at once), completes what it answered.

    Claims and completions come from this thread alone. A call that fails is reported and its request stays
    claimed: nothing is tried again. Answers of requests that are no longer current are kept, not fresh.
    """
    if not 1 <= workers <= MOST_WORKERS:
        raise RuleError(f"1 to {MOST_WORKERS} calls run at once")
    pending = requests.session.rows("agent_pending")
    claims = [requests.claim(request) for request, *_ in pending]
    done: list[dict] = []
    with ThreadPoolExecutor(workers) as pool:
        for claim, told in zip(claims, [pool.submit(call, claim) for claim in claims], strict=True):
            problem: Any = told.exception()
            done.append({"request": claim["request"], "problem": repr(problem)} if problem else requests.complete(claim["request"], told.result()))
    return done
