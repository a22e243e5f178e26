"""State machines of the keyed stream operators (STM*), free of Spark: step(state, row) gives (state, outputs).

A state is a JSON-ready dict, empty at first. Rows are dicts with ``at`` in milliseconds. The same machine runs in a stream, over a batch, and in tests.
"""

from __future__ import annotations

from collections.abc import Callable

State = dict
Row = dict
Machine = Callable[[State, Row], tuple[State, list[tuple]]]
Flush = Callable[[State], tuple[State, list[tuple]]]


def seen_within(ttl_ms: int, most: int = 0) -> Machine:
    """(id, duplicate): seen less than ttl_ms ago, and each sight counts anew; the oldest of more than ``most`` are forgotten. Blank ids are never duplicates.

    A ttl of 0 never expires. Reading expires at exactly the ttl, pruning only beyond it.
    """

    def step(state: State, row: Row):
        if not row["item"]:
            return state, [(row["id"], False)]
        held, now = dict(state.get("seen", {})), row["at"]
        last = held.pop(row["item"], None)
        duplicate = last is not None and not (ttl_ms > 0 and now - last >= ttl_ms)
        held[row["item"]] = now
        if not duplicate:
            held = {k: t for k, t in held.items() if ttl_ms <= 0 or t >= now - ttl_ms}
            while most and len(held) > most:
                held.pop(next(iter(held)))
        return {"seen": held}, [(row["id"], duplicate)]

    return step


def debounce(gap_ms: int) -> tuple[Machine, Flush]:
    """(first id, items, last at): items of a key until none came for gap_ms; one that may not wait flushes the others first and goes alone."""

    def flush(state: State):
        held = state.get("held") or []
        return {}, [(held[0][0], len(held), held[-1][1])] if held else []

    def step(state: State, row: Row):
        held = state.get("held") or []
        out: list[tuple] = []
        if held and row["at"] - held[-1][1] >= gap_ms:
            state, out = flush(state)
            held = []
        if not row["waits"]:
            _, more = flush({"held": held})
            return {}, [*out, *more, (row["id"], 1, row["at"])]
        return {"held": [*held, [row["id"], row["at"]]]}, out

    return step, flush


def fixed_window(most: int, window_ms: int) -> Machine:
    """(id, allowed, remaining, retry_after_ms): the window begins with its first request, not on a clock."""
    most, window_ms = max(1, most), max(1, window_ms)

    def step(state: State, row: Row):
        start, count, now = state.get("start"), state.get("count", 0), row["at"]
        if start is None or now - start >= window_ms:
            start, count = now, 0
        allowed = count < most
        count += allowed
        return {"start": start, "count": count}, [(row["id"], allowed, most - count, 0 if allowed else max(0, start + window_ms - now))]

    return step


def lockout(most: int, window_ms: int, lock_ms: int) -> Machine:
    """(id, locked, remaining): failures within a sliding window; the most-th locks, and what comes while locked doesn't count."""

    def step(state: State, row: Row):
        now, until = row["at"], state.get("until")
        if until is not None and now < until:
            return state, [(row["id"], True, 0)]
        recent = [] if until is not None else [t for t in state.get("failures", []) if t > now - window_ms]
        recent.append(now)
        full = len(recent) >= most
        return {"failures": recent, **({"until": now + lock_ms} if full else {})}, [(row["id"], full, max(0, most - len(recent)))]

    return step


def bounded_queue(cap: int, policy: str, lines: int | None = None) -> Machine:
    """(id, accepted, size, dropped): a full queue refuses new items, or drops its oldest, keeping summary lines of them if asked; a row with ``drain`` empties it."""

    def step(state: State, row: Row):
        items, dropped, notes = list(state.get("items", [])), state.get("dropped", 0), list(state.get("notes", []))
        if row.get("drain"):
            return {}, [(row["id"], True, 0, dropped)]
        if cap > 0 and len(items) >= cap:
            if policy == "new":
                return state, [(row["id"], False, len(items), dropped)]
            gone, items = items[: len(items) - cap + 1], items[len(items) - cap + 1 :]
            dropped += len(gone)
            if policy == "summarize":
                notes = [*notes, *gone][-(cap if lines is None else lines) or len(notes) + len(gone) :]
        items.append(row["item"])
        return {"items": items, "dropped": dropped, "notes": notes}, [(row["id"], True, len(items), dropped)]

    return step


def ring(n: int = 50) -> Machine:
    """(id, size, oldest): the last n entries."""

    def step(state: State, row: Row):
        items = [*state.get("items", []), row["item"]][-n:]
        return {"items": items}, [(row["id"], len(items), items[0])]

    return step


def coalesce(least: int, most: int, idle_ms: int, joiner: str = "") -> tuple[Machine, Flush]:
    """(first id, text): texts joined until ``most`` characters, or ``least`` and idle; other reply targets and media flush first, and media goes alone."""
    least = max(1, least)
    most = max(least, most)

    def flush(state: State):
        return {}, [(state["first"], state["text"])] if state.get("text") else []

    def step(state: State, row: Row):
        out: list[tuple] = []
        if state.get("text") and row["at"] - state["last"] >= idle_ms and len(state["text"]) >= least:
            state, out = flush(state)
        if row.get("media"):
            state, more = flush(state)
            return state, [*out, *more, (row["id"], row["item"] or "")]
        text = row["item"] or ""
        if not text.strip():
            return state, out
        if state.get("text") and (row.get("reply") and row["reply"] != state.get("reply") or bool(row.get("voice")) != state.get("voice")):
            state, more = flush(state)
            out += more
        fresh = {"first": row["id"], "reply": row.get("reply"), "voice": bool(row.get("voice")), "last": row["at"]}
        joined = state["text"] + joiner + text if state.get("text") else text
        if len(joined) > most:
            state, more = flush(state)
            out += more
            if len(text) >= most:
                return {}, [*out, (row["id"], text)]
            return {**fresh, "text": text}, out
        kept = {**(state if state.get("text") else fresh), "text": joined, "last": row["at"]}
        if len(joined) >= most:
            kept, more = flush(kept)
            out += more
        return kept, out

    return step, flush


def ttl_cap(ttl_ms: int, most: int) -> Machine:
    """(id, size): entries idle beyond the ttl go, then the oldest over the cap."""

    def step(state: State, row: Row):
        held = {k: t for k, t in state.get("held", {}).items() if row["at"] - t <= ttl_ms or ttl_ms <= 0}
        held.pop(row["item"], None)
        held[row["item"]] = row["at"]
        by_age = sorted(held.items(), key=lambda x: (x[1], x[0]))
        held = dict(by_age[max(0, len(by_age) - most) :])
        return {"held": held}, [(row["id"], len(held))]

    return step


def presence(tracked: tuple[str, ...], patch: Callable[[Row], dict]) -> Machine:
    """(id, changed): a row's patch is merged into the row, lists as sets; the tracked fields that changed, comma-joined."""

    def step(state: State, row: Row):
        before = state.get("row", {})
        merged = dict(before)
        for k, v in patch(row).items():
            if isinstance(v, list):
                clean = [x.strip() for x in [*before.get(k, []), *v] if x.strip()]
                merged[k] = list(dict.fromkeys(clean))
            elif v is not None:
                merged[k] = v
        changed = [k for k in tracked if merged.get(k) != before.get(k)]
        return {"row": merged}, [(row["id"], ",".join(changed))]

    return step


def sync_trigger(delta_bytes: int = 100_000, delta_messages: int = 50) -> Machine:
    """(id, bytes, messages): a row that reaches either delta since the last one fires and starts anew."""

    def step(state: State, row: Row):
        size, count = state.get("bytes", 0) + row["size"], state.get("messages", 0) + 1
        if size >= delta_bytes or count >= delta_messages:
            return {}, [(row["id"], size, count)]
        return {"bytes": size, "messages": count}, []

    return step


def pending_work(ttl_ms: int) -> Machine:
    """(id, accepted, revision, size): one open item of each type, those past their expiry gone; an acknowledgement takes one away. Every change is a revision."""

    def step(state: State, row: Row):
        held = {k: t for k, t in state.get("held", {}).items() if t > row["at"]}
        revision = state.get("revision", 0) + (len(held) < len(state.get("held", {})))
        accepted = False
        if row.get("ack"):
            if held.pop(row["item"], None) is not None:
                revision += 1
        elif row["item"] not in held:
            held[row["item"]], accepted, revision = row["at"] + ttl_ms, True, revision + 1
        return {"held": held, "revision": revision}, [(row["id"], accepted, revision, len(held))]

    return step


def latest_offset() -> Machine:
    """(id, offset): the highest source offset so far; another identity starts anew."""

    def step(state: State, row: Row):
        same = state.get("identity") == row["identity"]
        offset = max(state.get("offset", 0), row["offset"]) if same else row["offset"]
        return {"identity": row["identity"], "offset": offset}, [(row["id"], offset)]

    return step


def replay(machine: Machine, rows: list[Row], flush: Flush | None = None) -> list[tuple]:
    """All outputs over rows in order, with what is left at the end."""
    state: State = {}
    out: list[tuple] = []
    for row in rows:
        state, more = machine(state, row)
        out += more
    return out + (flush(state)[1] if flush else [])
