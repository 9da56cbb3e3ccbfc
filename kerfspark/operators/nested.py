"""Nested graph documents to flat tables, by structural variants.

A bottom-up tree automaton reads every JSON value from its leaves: a leaf's state is its type (for ``node_type`` also which
type it names), a list's state follows from the set of its entries' states, an object's from its keys and their values'
states, keys outside the alphabet being read as ``*``. A text that holds JSON has the state of what it holds, marked as
text. Equal shapes so have equal states in every task, named by a hash of the transition, and everything else is decided by
state: where nodes hang, whether a node's fields are its own or under ``data``, its subtype, and whether its coordinates,
hypotheses and evidence are lists, one object, one vector or nothing (``Plan``, made once a state). Nodes go to the typed
tables ``geometry_table``, ``feature_table`` and ``other_table`` beside the supertype table ``node_table``; children to
``vertices``, ``hypotheses`` and ``evidence``; all have the keys (graph_id, node_id) and the place in the parent.
``variant_table`` lists the states of nodes that occur, with their transition, route and count.

Of each graph the latest complete delivery counts (of two received at once, that with the larger delivery_id). Rows
without graph_id are left out; null, empty, broken or non-object payloads, and such nested deeper than the JSON reader
goes (some ten thousand levels), are no deliveries; null entries of a list keep their place and give no row; a node without
id gets its place as id; nodes of all containers of a payload count; of a node id that comes again, children at places
that were there before are left out. An empty table gives empty tables. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

NODE = "graph_id string, node_id string, node_pos bigint, subtype string, variant string, shape string, name string, layer string, confidence double, diameter_mm double, is_closed boolean"
CHILD = "graph_id string, node_id string, child_kind string, child_pos bigint, shape string, x double, y double, numbers array<double>, name string, score double, detail string"
#: The alphabet of keys; any other key is read as ``*``.
KEYS = frozenset(["nodes", "data", "id", "node_id", "node_type", "geometry_type", "coordinates", "x", "y", "feature_class", "hypotheses", "provenance", "evidence", "layer", "confidence", "diameter_mm", "is_closed"])
#: Rows a task holds before it hands them on; states a task remembers before it starts anew.
ROWS, STATES = 20_000, 100_000


def complete(text: str | None):
    """The object a text holds as complete JSON, else None."""

    def refuse(word):
        raise ValueError(word)

    try:
        value = json.loads(text, parse_constant=refuse)
    except (ValueError, TypeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


@dataclass(frozen=True)
class Plan:
    """What a node's state says about it: its route and where its children are."""

    subtype: str
    under_data: bool
    forms: dict = field(default_factory=dict)


class Automaton:
    """States of the values of one payload after another."""

    LEAVES = {type(None): "null", bool: "flag", int: "number", float: "number", str: "text"}

    def __init__(self):
        self.moves: dict[str, tuple] = {}
        self.names: dict[tuple, str] = {}
        self.plans: dict[str, Plan] = {}
        self.holding: set[str] = set()
        self.at: dict[int, str] = {}
        self.texts: dict[int, object] = {}

    def name(self, move: tuple) -> str:
        """The state a transition leads to."""
        if move in self.names:
            return self.names[move]
        q = self.names[move] = f"{move[0][0]}{hashlib.blake2b(repr(move).encode(), digest_size=6).hexdigest()}"
        self.moves[q] = move
        below = [s for k, s in move[1] if k != "nodes"] if move[0] == "object" else move[1]
        if (move[0] == "object" and any(k == "nodes" for k, _ in move[1])) or any(self.bare(s) in self.holding for s in below):
            self.holding.add(q)
        return q

    @staticmethod
    def bare(q: str) -> str:
        """The state of what a text holds, or the state itself."""
        return q[5:] if q.startswith("text:") else q

    def leaf(self, value, key) -> str:
        if key == "node_type" and isinstance(value, str):
            named = value.strip().lower()
            return f"is {named}" if named in ("geometry", "feature") else "is other" if named else "text"
        return self.LEAVES[type(value)]

    def read(self, value) -> None:
        """States of a value and all its parts, without recursion; those of the payload before are forgotten."""
        if len(self.moves) > STATES:
            self.moves, self.names, self.plans, self.holding = {}, {}, {}, set()
        self.at, self.texts = {}, {}
        done: list[str] = []
        work = [(value, None, False)]
        while work:
            value, key, parts_done = work.pop()
            if isinstance(value, str) and value.lstrip()[:1] in ("{", "[") and key != "node_type" and not parts_done:
                try:
                    held = json.loads(value)
                except (ValueError, RecursionError):
                    held = None
                if isinstance(held, (dict, list)):
                    self.texts[id(value)] = held
                    work += [(value, key, True), (held, key, False)]
                    continue
            if isinstance(value, str) and parts_done:
                done.append(f"text:{done.pop()}")
            elif isinstance(value, dict):
                if parts_done:
                    states = done[len(done) - len(value) :] if value else []
                    del done[len(done) - len(states) :]
                    move = tuple(sorted({(k if k in KEYS else "*", s) for k, s in zip(value, states)}))
                    self.at[id(value)] = q = self.name(("object", move))
                    done.append(q)
                else:
                    work.append((value, key, True))
                    work += [(v, k, False) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                if parts_done:
                    states = done[len(done) - len(value) :] if value else []
                    del done[len(done) - len(states) :]
                    self.at[id(value)] = q = self.name(("list", tuple(sorted(set(states)))))
                    done.append(q)
                else:
                    work.append((value, key, True))
                    work += [(v, None, False) for v in reversed(value)]
            else:
                done.append(self.leaf(value, key))

    def open(self, value):
        """What a text holds, or the value itself."""
        return self.texts.get(id(value), value) if isinstance(value, str) else value

    def keys(self, q: str) -> dict[str, str]:
        """Of an object's state: its keys of the alphabet with a state each."""
        move = self.moves.get(self.bare(q), ("", ()))
        return dict(x for x in move[1] if x[0] != "*") if move[0] == "object" else {}

    def form(self, q: str | None, flat: bool = False) -> str:
        """How children are given: ``list``, ``one`` (an object), ``vector`` (a flat list of numbers, where that is one child) or ``none``."""
        kind, parts = self.moves.get(self.bare(q or ""), ("", ()))
        if kind == "object":
            return "one"
        if kind != "list":
            return "none"
        return "vector" if flat and "number" in parts and set(parts) <= {"number", "null"} else "list"

    def plan(self, q: str) -> Plan:
        if q not in self.plans:
            fields = self.keys(q)
            data = self.keys(fields["data"]) if self.form(fields.get("data")) == "one" else None
            fields = fields | (data or {})
            kind = fields.get("node_type", "")
            if kind == "is geometry" or (not kind.startswith("is ") and ("coordinates" in fields or "geometry_type" in fields)):
                subtype = "geometry"
            elif kind == "is feature" or (not kind.startswith("is ") and ("hypotheses" in fields or "feature_class" in fields)):
                subtype = "feature"
            else:
                subtype = "other"
            forms = {"coordinates": self.form(fields.get("coordinates"), flat=True), "hypotheses": self.form(fields.get("hypotheses")), "provenance": self.form(fields.get("provenance"))}
            self.plans[q] = Plan(subtype, data is not None, forms)
        return self.plans[q]

    def containers(self, payload: dict) -> Iterator[list | dict]:
        """Everything under a key ``nodes``, outside of nodes, in the order of the payload; only states that hold such are entered."""
        work = [payload]
        while work:
            value = self.open(work.pop())
            if isinstance(value, dict) and isinstance(self.open(value.get("nodes")), (list, dict)):
                yield self.open(value["nodes"])
            inner = [v for k, v in value.items() if k != "nodes"] if isinstance(value, dict) else value
            opened = (self.open(v) for v in reversed(inner))
            work += [v for v in opened if isinstance(v, (dict, list)) and self.at[id(v)] in self.holding]

    def nodes(self, payload: dict) -> Iterator[tuple[int, str, str, Plan, dict]]:
        """Place, id, state, plan and fields of each node."""
        self.read(payload)
        place = 0
        for listed in self.containers(payload):
            if isinstance(listed, dict):
                move = self.moves[self.at[id(listed)]][1]
                single = any(k in ("node_type", "data") for k, _ in move) and any(self.form(s) != "one" for _, s in move)
                pairs = [(None, listed)] if single else list(listed.items())
            else:
                pairs = [(None, x) for x in listed]
            for key, node in pairs:
                node = self.open(node)
                if isinstance(node, dict):
                    q = self.at[id(node)]
                    plan = self.plan(q)
                    fields = {**node, **self.open(node["data"])} if plan.under_data else node
                    names = (node.get("id"), node.get("node_id"), key, fields.get("id"), fields.get("node_id"))
                    yield place, next((str(x) for x in names if x is not None), str(place)), q, plan, fields
                place += 1

    def entries(self, value, form: str) -> list[tuple[int, object]]:
        """Places and entries of children in a form; nulls keep their place and go."""
        value = self.open(value)
        if form == "list":
            return [(i, self.open(x)) for i, x in enumerate(value) if x is not None]
        return [] if form == "none" else [(0, value)]

    def shape(self, value) -> str:
        value = self.open(value)
        return self.at.get(id(value)) or self.LEAVES.get(type(value), "text")

    def children(self, plan: Plan, fields: dict) -> Iterator[tuple]:
        if plan.subtype == "geometry":
            for i, v in self.entries(fields.get("coordinates"), plan.forms["coordinates"]):
                at = [number(x) for x in v] if isinstance(v, list) else [number(v.get(k)) for k in ("x", "y")] if isinstance(v, dict) else [number(v)]
                yield "vertex", i, self.shape(v), (at + [None])[0], (at + [None, None])[1], at, None, None, None
        if plan.subtype == "feature":
            for i, v in self.entries(fields.get("hypotheses"), plan.forms["hypotheses"]):
                f = v if isinstance(v, dict) else {"feature_class": v}
                yield "hypothesis", i, self.shape(v), None, None, None, text(f.get("feature_class")), number(f.get("confidence")), text(f.get("evidence"))
        for _, p in self.entries(fields.get("provenance"), plan.forms["provenance"]):
            if isinstance(p, dict):
                for i, v in self.entries(p.get("evidence"), self.form(self.keys(self.at[id(p)]).get("evidence"))):
                    f = v if isinstance(v, dict) else {"description": v}
                    yield "evidence", i, self.shape(v), None, None, None, text(f.get("evidence_type")), number(f.get("weight")), text(f.get("description"))

    def spelled(self, q: str, depth: int = 3) -> str:
        """A state's transition in words, to a depth; deeper parts by their names."""
        mark, q = ("text of ", q[5:]) if q.startswith("text:") else ("", q)
        kind, parts = self.moves.get(q, ("", ()))
        if not kind or not depth:
            return mark + q
        if kind == "list":
            return f"{mark}[{'|'.join(self.spelled(s, depth - 1) for s in parts)}]"
        return f"{mark}{{{', '.join(f'{k}: {self.spelled(s, depth - 1)}' for k, s in parts)}}}"


def number(x) -> float | None:
    try:
        return None if x is None or isinstance(x, bool) else float(x)
    except (TypeError, ValueError, OverflowError):
        return None


def text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def tables(columns: str, rows_of):
    """A function of batches of payloads that hands on the rows of ``rows_of(automaton, graph, payload)`` in pieces of bounded size."""
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton()
        rows: list[tuple] = []
        for batch in batches:
            for graph, payload in zip(batch["graph_id"], batch["payload"]):
                for row in rows_of(automaton, graph, complete(payload) or {}):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    return run


def node_rows(automaton: Automaton, graph: str, payload: dict) -> Iterator[tuple]:
    for i, name, q, plan, f in automaton.nodes(payload):
        closed = f.get("is_closed")
        label = f.get("feature_class") if plan.subtype == "feature" else f.get("geometry_type")
        yield graph, name, i, plan.subtype, q, automaton.spelled(q), text(label), text(f.get("layer")), number(f.get("confidence")), number(f.get("diameter_mm")), closed if isinstance(closed, bool) else None


def child_rows(automaton: Automaton, graph: str, payload: dict) -> Iterator[tuple]:
    seen: dict[tuple, int] = {}
    for place, name, _, plan, f in automaton.nodes(payload):
        for c in automaton.children(plan, f):
            if seen.setdefault((name, c[0], c[1]), place) == place:
                yield graph, name, *c


@F.pandas_udf(BooleanType())
def is_complete(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: complete(x) is not None).astype(bool)


def latest(docs: DataFrame) -> DataFrame:
    """graph_id and payload of the latest complete delivery of each graph. Of payloads only the winners are shuffled, if any are."""
    kept = docs.where(F.col("graph_id").isNotNull() & F.col("payload").isNotNull())
    best = kept.where(is_complete("payload")).groupBy("graph_id").agg(F.max(F.struct("received_at", "delivery_id")).alias("_best"))
    won = best.select(F.col("_best.delivery_id").alias("delivery_id"))
    return kept.select("delivery_id", "graph_id", "payload").join(won, "delivery_id", "left_semi").select("graph_id", "payload")


def node_table(docs: DataFrame) -> DataFrame:
    """The supertype table of all nodes."""
    return latest(docs).mapInPandas(tables(NODE, node_rows), NODE)


def geometry_table(docs: DataFrame) -> DataFrame:
    return node_table(docs).where("subtype = 'geometry'").select("graph_id", "node_id", "node_pos", "variant", F.col("name").alias("geometry_type"), "layer", "diameter_mm", "is_closed")


def feature_table(docs: DataFrame) -> DataFrame:
    return node_table(docs).where("subtype = 'feature'").select("graph_id", "node_id", "node_pos", "variant", F.col("name").alias("feature_class"), "confidence", "diameter_mm")


def other_table(docs: DataFrame) -> DataFrame:
    return node_table(docs).where("subtype = 'other'").select("graph_id", "node_id", "node_pos", "variant", "shape")


def variant_table(docs: DataFrame) -> DataFrame:
    """(variant, subtype, shape, nodes, graphs): the automaton's states of nodes that occur, and where they are routed."""
    return node_table(docs).groupBy("variant", "subtype", "shape").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("graph_id").alias("graphs"))


def child_table(docs: DataFrame) -> DataFrame:
    """All children of all kinds; the subtype tables below are its routes."""
    return latest(docs).mapInPandas(tables(CHILD, child_rows), CHILD)


def vertices(docs: DataFrame) -> DataFrame:
    return child_table(docs).where("child_kind = 'vertex'").select("graph_id", "node_id", "child_pos", "shape", "x", "y", "numbers")


def hypotheses(docs: DataFrame) -> DataFrame:
    return child_table(docs).where("child_kind = 'hypothesis'").select("graph_id", "node_id", "child_pos", F.col("name").alias("feature_class"), F.col("score").alias("confidence"), F.col("detail").alias("evidence"))


def evidence(docs: DataFrame) -> DataFrame:
    return child_table(docs).where("child_kind = 'evidence'").select("graph_id", "node_id", "child_pos", F.col("name").alias("evidence_type"), F.col("score").alias("weight"), F.col("detail").alias("description"))
