"""Secret scans with one combined deterministic automaton.

Each rule is a head, a body and the least size of what the body takes.  All rules' expressions
become one automaton by Thompson's construction, subset construction and minimisation by partition
refinement; it is laid out as one array of transitions, and one pass over a text's bytes drives all
rules.  A state carries the set of rules that accept there.  Where a rule stops accepting, the rule's
longest match ends, and the same machinery compiled for the reversed rule finds its leftmost start.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import per_batch, small_batches, spread


@dataclass(frozen=True)
class Rule:
    """``head body`` where the body takes at least ``least`` characters; shorter matches are dropped.

    ``fold`` lets the head's letters match in either case.  With ``head`` empty, ``body`` is one
    character class, of which runs of ``least`` or more match.
    """

    kind: str
    head: str
    body: str
    least: int = 0
    fold: bool = False


# The base rules, in the order in which kinds are listed, and further public token formats.  Bodies that can
# run side by side multiply the automaton's states, so formats are added by weight.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]+", 24),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]+", 24),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]+", 24),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", ""),
    # The whole key: header fields such as DEK-Info, base64 with line ends (or their escapes), END line.
    Rule("pem_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", r"(\x0d?\x0a[A-Z][A-Za-z-]*:[\x20-\x7e]*)*[A-Za-z0-9+/=\x5c\x09\x0a\x0d\x20]*-----END ([A-Z]+ )*PRIVATE KEY-----"),
)


class Expression:
    """A parser for byte expressions: literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n,}``.

    Parsed expressions are trees of ('set', bytes), ('cat', parts), ('alt', parts), ('star', part).
    """

    def __init__(self, source: str, fold: bool = False):
        self.source, self.at, self.fold = source, 0, fold
        self.tree = self._alternatives()
        if self.at != len(source):
            raise ValueError(f"unbalanced expression {source!r}")

    def _peek(self) -> str:
        return self.source[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.source[self.at - 1]

    def _alternatives(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._take()
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self):
        part = self._atom()
        while self._peek() and self._peek() in "?*+{":
            sign = self._take()
            if sign == "?":
                part = ("alt", [part, ("cat", [])])
            elif sign == "*":
                part = ("star", part)
            elif sign == "+":
                part = ("cat", [part, ("star", part)])
            else:
                close = self.source.index(",}", self.at)
                part = ("cat", [part] * int(self.source[self.at : close]) + [("star", part)])
                self.at = close + 2
        return part

    def _byte(self) -> int:
        c = self._take()
        if c != "\\":
            return ord(c)
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.source[self.at - 2 : self.at], 16)
        return ord(c)

    def _either_case(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(found)

    def _atom(self):
        if self._peek() == "(":
            self._take()
            inside = self._alternatives()
            if self._peek() != ")":
                raise ValueError(f"unbalanced expression {self.source!r}")
            self._take()
            return inside
        if self._peek() != "[":
            return ("set", self._either_case({self._byte()}))
        self._take()
        found: set[int] = set()
        while self._peek() != "]":
            low = self._byte()
            if self._peek() == "-" and self.source[self.at + 1 : self.at + 2] != "]":
                self._take()
                found |= {*range(low, self._byte() + 1)}
            else:
                found.add(low)
        self._take()
        return ("set", self._either_case(found))


def _reversed(tree):
    kind, inside = tree
    if kind == "set":
        return tree
    if kind == "star":
        return (kind, _reversed(inside))
    parts = [_reversed(p) for p in inside]
    return (kind, parts[::-1] if kind == "cat" else parts)


class Automaton:
    """A minimal deterministic automaton over bytes for several expressions.

    ``move[state << 8 | byte]`` is the next state, ``accept[state]`` the mask of expressions that
    accept there.  States that accept come last, from ``first_accepting`` on.  With ``anywhere`` a
    match may start at any byte; else the run starts at the first, and state ``dead`` ends it.
    """

    def __init__(self, trees: Sequence, anywhere: bool):
        self._edges: list[list[tuple[frozenset[int] | None, int]]] = []
        starts, ends = [], {}
        for number, tree in enumerate(trees):
            a, b = self._node(), self._node()
            self._build(tree, a, b)
            starts.append(a)
            ends[b] = 1 << number
        self._subsets(starts, ends, anywhere)
        self._minimise()

    def _node(self) -> int:
        self._edges.append([])
        return len(self._edges) - 1

    def _build(self, tree, a: int, b: int) -> None:
        kind, inside = tree
        if kind == "set":
            self._edges[a].append((inside, b))
        elif kind == "star":
            m = self._node()
            self._edges[a].append((None, m))
            self._edges[m].append((None, b))
            self._build(inside, m, m)
        elif kind == "alt":
            for part in inside:
                self._build(part, a, b)
        else:
            for part in inside:
                m = self._node()
                self._build(part, a, m)
                a = m
            self._edges[a].append((None, b))

    def _closed(self, nodes) -> frozenset[int]:
        found, todo = set(nodes), [*nodes]
        while todo:
            for label, to in self._edges[todo.pop()]:
                if label is None and to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)

    def _subsets(self, starts: list[int], ends: dict[int, int], anywhere: bool) -> None:
        labels = {label for edges in self._edges for label, _ in edges if label is not None}
        groups: dict[tuple, list[int]] = {}
        for byte in range(256):
            groups.setdefault(tuple(byte in label for label in labels), []).append(byte)
        again = starts if anywhere else []
        order = [self._closed(starts)]
        number, rows = {order[0]: 0}, []
        for state in order:  # grows while it is walked
            row = [0] * 256
            for members in groups.values():
                sample = members[0]
                to = [t for n in state for label, t in self._edges[n] if label is not None and sample in label]
                target = self._closed([*to, *again])
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                for byte in members:
                    row[byte] = number[target]
            rows.append(row)
        self._columns = [members[0] for members in groups.values()]
        self._rows = rows
        self._masks = [sum({ends[n] for n in state if n in ends}) for state in order]

    def _minimise(self) -> None:
        """Refine by accept mask, then by the parts that transitions lead to, until nothing splits."""
        part = self._masks
        count = len(set(part))
        while True:
            names: dict[tuple, int] = {}
            refined = [names.setdefault((part[s], *(part[self._rows[s][c]] for c in self._columns)), len(names)) for s in range(len(part))]
            part = refined
            if len(names) == count:
                break
            count = len(names)
        sample: dict[int, int] = {}
        for s, p in enumerate(part):
            sample.setdefault(p, s)
        order = sorted(sample, key=lambda p: (self._masks[sample[p]] > 0, sample[p]))
        new = {p: i for i, p in enumerate(order)}
        self.start = new[part[0]]
        shifted = [n << 8 for n in range(len(order))]  # shared by all entries
        self.move = [shifted[new[part[t]]] for p in order for t in self._rows[sample[p]]]
        self.accept = [self._masks[sample[p]] for p in order]
        self.first_accepting = sum(not m for m in self.accept)
        self.dead = next((i for i in range(len(order)) if not self.accept[i] and all(self.move[i << 8 | c] == i << 8 for c in range(256))), -1)
        del self._edges, self._rows, self._masks, self._columns

    def longest(self, data: bytes, start: int = 0) -> int:
        """The length of the longest match that starts at ``start``, or -1."""
        state, move, best = self.start << 8, self.move, 0 if self.accept[self.start] else -1
        for n, byte in enumerate(data[start:] if start else data, 1):
            state = move[state | byte]
            if state >> 8 == self.dead:
                break
            if self.accept[state >> 8]:
                best = n
        return best


class Scanner:
    """All rules compiled; ``spans`` gives a text's matches of every rule."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        trees = []
        for rule in self.rules:
            body = rule.body if rule.head else f"{rule.body.removesuffix('+')}{{{rule.least},}}"
            trees.append(("cat", [Expression(rule.head, rule.fold).tree, Expression(body).tree]))
        self.scan = Automaton(trees, anywhere=True)
        self.back = [Automaton([_reversed(tree)], anywhere=False) for tree in trees]
        self.heads = [Automaton([Expression(rule.head, rule.fold).tree], anywhere=False) for rule in self.rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) wherever a rule has accepted and does so no longer: the one pass over the bytes."""
        move, first, accept = self.scan.move, self.scan.first_accepting << 8, self.scan.accept
        state, live, out = self.scan.start << 8, 0, []
        for at, byte in enumerate(data):
            state = move[state | byte]
            if state >= first or live:
                now = accept[state >> 8]
                over = live & ~now
                if over:
                    out += [(r, at) for r in range(len(self.rules)) if over >> r & 1]
                live = now
        out += [(r, len(data)) for r in range(len(self.rules)) if live >> r & 1]
        return out

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) by start, then rule: for each rule leftmost, longest, not overlapping."""
        floor, out = [0] * len(self.rules), []
        for rule, end in self.ends(data):
            size = self.back[rule].longest(data[floor[rule] : end][::-1])
            if size < 0:
                continue
            floor[rule] = end
            head = self.heads[rule].longest(data[end - size : end])
            if size - head >= self.rules[rule].least:
                out.append((rule, end - size, end))
        return sorted(out, key=lambda s: (s[1], s[0]))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """``byte_spans`` in code points."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if not found or len(data) == len(text):
            return found
        place, at, points = {}, 0, 0
        for cut in sorted({x for _, *both in found for x in both}):
            points += len(data[at:cut].decode("utf-8", "surrogatepass"))
            at, place[cut] = cut, points
        return [(rule, place[a], place[b]) for rule, a, b in found]


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> Scanner:
    """The compiled rules, made once in each Python process."""
    return Scanner(rules)


def _listed(rules: Sequence[Rule], spans) -> str:
    return ",".join([f"{rules[r].kind}:{a}:{b}" for r, a, b in spans])


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in every whole text; one map over the rows, no shuffle.

    Returns ``id_col``, ``n_assign``, ``n_access``, ``n_hex`` (matches of the base rules),
    ``base_sha256`` (of the base spans as kind:start:end, by start and then kind, joined by commas;
    code points, end exclusive) and ``spans`` (the same listing of all rules' spans).  A null or
    empty text has none; repeated rows and null ids are scanned alike; an empty table gives an
    empty result; texts of any length are scanned whole.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    base = len(BASE_RULES)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = scanner()
        counts, digests, listed = [[] for _ in range(base)], [], []
        for text in batch.column(1).to_pylist():
            spans = machine.spans(text) if text else []
            own = [s for s in spans if s[0] < base]
            for r in range(base):
                counts[r].append(sum(s[0] == r for s in own))
            digests.append(hashlib.sha256(_listed(machine.rules, own).encode()).hexdigest())
            listed.append(_listed(machine.rules, spans))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return per_batch(spread(documents.select(id_col, text_col)), make, schema)


def redact(documents: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span of every rule replaced by ``mark`` in the texts.

    Overlapping spans become one mark.  Texts without secrets, null and empty ones stay as they are, and
    so do all other columns, of any name; repeated rows are each redacted; an empty table gives an empty
    one; texts of any length are scanned whole.
    """
    at = documents.columns.index(text_col)
    small_batches(documents.sparkSession)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, texts = scanner(), []
        for text in batch.column(at).to_pylist():
            if text:
                out, done = [], 0
                for _, a, b in machine.spans(text):
                    if a >= done:
                        out += (text[done:a], mark)
                    done = max(done, b)
                text = "".join([*out, text[done:]]) if out else text
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(lambda batches: (make(b) for b in batches), documents.schema)
