"""Secret scan with one deterministic automaton for all rules.

The rule expressions are compiled together: each is reversed, all become one
nondeterministic automaton that may start anywhere, subset construction makes it
deterministic over byte classes, and states are merged until minimal. One pass
over the bytes, from the last to the first, then marks for every rule all places
where a match begins. From each such place that an earlier match has not used, the
rule's own forward automaton, compiled the same way, runs to the longest end.
Bytes are read in lanes of equal length, side by side. A lane begins in the state
that some bytes before it lead to; where the lane before ends in another state after
all, it is read again from that one, so the result is that of one pass whatever the
text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


class Rule(NamedTuple):
    """kind, expression, and what a match (as bytes) must fulfil; failing matches are dropped and use up their characters."""

    kind: str
    pattern: str
    passes: Callable[[bytes], bool] | None = None
    any_case: str = ""  # this leading part of the expression matches in either case


def _value_length(match: bytes) -> bool:
    """The value after the separator has six or more characters."""
    i = min(k for k in (match.find(b"="), match.find(b":")) if k >= 0)
    return len(match[i + 1 :].lstrip(b" ").lstrip(b"\"'")) >= 6


# The rules. The first three are the base; the others are added.
RULES = (
    Rule("assign", r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _value_length, "(password|passwd|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*"),  # the same spans as runs of [0-9a-f] of 24 or more
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m) >= 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", lambda m: len(m) >= 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", lambda m: len(m) >= 24),
    Rule("npm", r"npm_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = tuple(r.kind for r in RULES)


# --- expressions -> trees: ("set", frozenset of bytes), ("seq", [..]), ("alt", [..]), ("star", t)


def _parse(text: str, any_case: bool = False) -> tuple:
    at = 0

    def byte() -> int:
        nonlocal at
        c = text[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = text[at]
        at += 1
        if c == "x":
            at += 2
            return int(text[at - 2 : at], 16)
        return ord(c)

    def both(chars: set[int]) -> frozenset[int]:
        return frozenset(chars | {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}) if any_case else frozenset(chars)

    def members() -> frozenset[int]:
        nonlocal at
        found: set[int] = set()
        while text[at] != "]":
            low = byte()
            if text[at] == "-" and text[at + 1] != "]":
                at += 1
                found |= set(range(low, byte() + 1))
            else:
                found.add(low)
        at += 1
        return both(found)

    def one() -> tuple:
        nonlocal at
        if text[at] == "(":
            at += 1
            out = either()
            at += 1
        elif text[at] == "[":
            at += 1
            out = ("set", members())
        else:
            out = ("set", both({byte()}))
        while at < len(text) and text[at] in "?*+{":
            mark = text[at]
            at += 1
            if mark == "?":
                out = ("alt", [out, ("seq", [])])
            elif mark == "*":
                out = ("star", out)
            elif mark == "+":
                out = ("seq", [out, ("star", out)])
            else:
                end = text.index("}", at)
                out = ("seq", [out] * int(text[at:end]))
                at = end + 1
        return out

    def either() -> tuple:
        nonlocal at
        options, row = [], []
        while at < len(text) and text[at] != ")":
            if text[at] == "|":
                at += 1
                options.append(("seq", row))
                row = []
            else:
                row.append(one())
        return ("alt", [*options, ("seq", row)])

    return either()


def _reversed(tree: tuple) -> tuple:
    kind, x = tree
    if kind == "set":
        return tree
    if kind == "star":
        return ("star", _reversed(x))
    return (kind, [_reversed(t) for t in (reversed(x) if kind == "seq" else x)])


def _tree(rule: Rule) -> tuple:
    return ("seq", [*([_parse(rule.any_case, True)] if rule.any_case else []), _parse(rule.pattern)])


class Automaton(NamedTuple):
    """Transition arrays: state * n_classes + class of the byte -> state; accepts: bit mask of rules per state."""

    classes: np.ndarray
    n_classes: int
    table: np.ndarray
    accepts: np.ndarray
    dead: int  # the state that leads nowhere, or -1


def compile_rules(trees: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then merging of states that no text tells apart."""
    moves: list[list[tuple[frozenset[int], int]]] = []
    silent: list[list[int]] = []

    def node() -> int:
        moves.append([])
        silent.append([])
        return len(moves) - 1

    def build(tree: tuple, start: int) -> int:
        kind, x = tree
        if kind == "set":
            end = node()
            moves[start].append((x, end))
            return end
        if kind == "seq":
            for t in x:
                start = build(t, start)
            return start
        end = node()
        if kind == "alt":
            for t in x:
                silent[build(t, start)].append(end)
        else:
            silent[start].append(end)
            loop = node()
            silent[start].append(loop)
            silent[build(x, loop)] += [loop, end]
        return end

    first = node()
    final: dict[int, int] = {}
    for i, t in enumerate(trees):
        begin = node()
        silent[first].append(begin)
        final[build(t, begin)] = 1 << i

    def closed(nodes: set[int]) -> frozenset[int]:
        stack, seen = list(nodes), set(nodes)
        while stack:
            for n in silent[stack.pop()]:
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return frozenset(seen)

    sets = sorted({s for m in moves for s, _ in m}, key=sorted)
    marks: dict[tuple, int] = {}
    classes = np.zeros(256, dtype=np.uint8)
    sample: list[int] = []
    for b in range(256):
        mark = tuple(b in s for s in sets)
        if mark not in marks:
            marks[mark] = len(sample)
            sample.append(b)
        classes[b] = marks[mark]

    start = closed({first})
    ids, todo, rows = {start: 0}, [start], []
    for state in todo:
        row = []
        for b in sample:
            to = {n for s in state for chars, n in moves[s] if b in chars}
            nxt = closed(to | {first}) if anywhere else closed(to)
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    accepts = np.array([sum(final.get(n, 0) for n in s) for s in todo], dtype=np.int64)
    table = np.array(rows)

    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while they accept and move alike
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.unique(block, return_index=True)[1]
    rank = np.argsort(np.argsort(order))  # the first state stays the first
    block, order = rank[block], np.sort(order)
    table, accepts = block[table[order]], accepts[order]
    dead = next((i for i, r in enumerate(table) if (r == i).all() and not accepts[i]), -1)
    return Automaton(classes, len(sample), (table * len(sample)).astype(np.int32).ravel(), accepts, dead)


@cache
def _compiled() -> tuple[Automaton, list[tuple[Automaton, list[int], bytes]]]:
    """The scanner; per rule its forward automaton with a plain list as table."""
    trees = [_tree(r) for r in RULES]
    one = [compile_rules([t], False) for t in trees]
    return compile_rules([_reversed(t) for t in trees], True), [(a, a.table.tolist(), a.classes.tobytes()) for a in one]


#: Bytes read together, lanes they are read in at most, least bytes of a lane, and bytes before a lane that guess its first state.
CHUNK, LANES, LEAST, BEFORE = 1 << 23, 2048, 512, 64


def _run(table: np.ndarray, coded: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """States of all lanes after coded[step, lane]; out gets those after every step."""
    for t in range(len(coded)):
        state = table[state + coded[t]]
        if out is not None:
            out[t] = state
    return state


def begins(data: np.ndarray) -> np.ndarray:
    """Per byte of data, the mask of rules of which a match begins there (masks of bytes 0xFF, between texts, are zero)."""
    scan, _ = _compiled()
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    length = max(LEAST, -(-n // LANES))
    lanes = -(-n // length)
    back = np.full(lanes * length, 0xFF, dtype=np.uint8)
    back[:n] = data[::-1]
    coded = np.ascontiguousarray(scan.classes[back].reshape(lanes, length).T).astype(np.int32)
    first = np.zeros(lanes, dtype=np.int32)
    first[1:] = _run(scan.table, coded[-BEFORE:, :-1], np.zeros(lanes - 1, dtype=np.int32))
    out = np.empty((length, lanes), dtype=np.int32)
    ends = {None: _run(scan.table, coded, first, out)}
    if (first[1:] != ends[None][:-1]).any():
        # what each lane truly begins in, by the ends from every state that is met on the way
        true = np.zeros(lanes, dtype=np.int32)
        for i in range(lanes - 1):
            at = int(true[i])
            known = None if at == first[i] else at
            if known not in ends:
                ends[at] = _run(scan.table, coded, np.full(lanes, at, dtype=np.int32))
            true[i + 1] = ends[known][i]
        again = np.flatnonzero(true != first)
        fixed = np.empty((length, len(again)), dtype=np.int32)
        _run(scan.table, coded[:, again], true[again], fixed)
        out[:, again] = fixed
    return scan.accepts[out // scan.n_classes].T.ravel()[:n][::-1]


def _spans_at(data: bytes, where: np.ndarray, masks: np.ndarray) -> list[tuple[str, int, int]]:
    """Byte spans of one text from the places where matches begin."""
    _, one = _compiled()
    found = []
    for i, rule in enumerate(RULES):
        automaton, table, classes = one[i]
        accepts, dead = automaton.accepts, automaton.dead * automaton.n_classes
        used = 0
        for start in where[(masks >> i) & 1 == 1].tolist():
            if start < used:
                continue
            state, end = 0, start
            for k in range(start, len(data)):
                state = table[state + classes[data[k]]]
                if state == dead:
                    break
                if accepts[state // automaton.n_classes]:
                    end = k + 1
            used = end
            if not rule.passes or rule.passes(data[start:end]):
                found.append((rule.kind, start, end))
    return found


def scan_texts(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """Per text (kind, start, end) by start, then kind as in RULES; code points, end exclusive."""
    out: list[list[tuple[str, int, int]]] = []
    held: list[bytes] = []

    def flush() -> None:
        data = np.frombuffer(b"\xff".join(held) + b"\xff", dtype=np.uint8)
        masks = begins(data)
        hits = np.flatnonzero(masks)
        offset = 0
        for text in held:
            lo, hi = np.searchsorted(hits, [offset, offset + len(text)])
            spans = []
            if hi > lo:
                spans = _spans_at(text, hits[lo:hi] - offset, masks[hits[lo:hi]])
                points = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
                spans = [(k, int(points[a]), int(points[b])) for k, a, b in spans]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            out.append(spans)
            offset += len(text) + 1
        held.clear()

    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= CHUNK:
            flush()
            size = 0
    if held:
        flush()
    return out


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in scan_texts(list(texts))], dtype=object)


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a whole text.

    Null and empty texts have none; repeated rows give the same. Matches of one
    kind are leftmost, longest and don't overlap. Memory follows CHUNK bytes, or
    one text where that is longer.
    """
    return _spans(text)
