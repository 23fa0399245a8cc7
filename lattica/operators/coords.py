"""Coordinate transformations: a graph of rules from coordinates to coordinates, resolved on the driver into one projection."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import replace

from ..functions.quantity import Quantity
from .array import Coord, CoordError, LabelledArray
from .binning import Binned

Rule = str | Callable[..., Quantity]


class Graph:
    """``{"out": "alias_of", ("a", "b"): function, ...}``; a function takes coordinates by its parameter names.

    A function for several outputs returns a dict of them.
    """

    def __init__(self, rules: dict[str | tuple[str, ...], Rule]):
        self.rules: dict[str, tuple[tuple[str, ...], Rule]] = {}
        for outputs, rule in rules.items():
            outputs = (outputs,) if isinstance(outputs, str) else tuple(outputs)
            for out in outputs:
                if out in self.rules:
                    raise ValueError(f"two rules give {out!r}")
                self.rules[out] = (outputs, rule)

    @staticmethod
    def inputs(rule: Rule) -> list[str]:
        return [rule] if isinstance(rule, str) else list(inspect.signature(rule).parameters)

    def plan(self, have: set[str], targets: list[str]) -> list[str]:
        """The outputs to compute, in order; what is there is not computed anew unless it is asked for by a rule of its own."""
        order: list[str] = []
        active: list[str] = []

        def visit(name: str) -> None:
            if name in order or name in have:
                return
            if name in active:
                raise ValueError(f"a cycle: {' -> '.join([*active, name])}")
            if name not in self.rules:
                raise KeyError(f"no rule and no coordinate gives {name!r}")
            active.append(name)
            for x in self.inputs(self.rules[name][1]):
                visit(x)
            active.pop()
            order.append(name)

        for t in targets:
            visit(t)
        return order

    def show(self) -> str:
        return "\n".join(f"{', '.join(self.inputs(rule))} -> {out}" for out, (_, rule) in self.rules.items())

    def graph_for(self, have: set[str], targets: list[str]) -> Graph:
        return Graph({out: self.rules[out][1] for out in self.plan(have, targets)})


def transform_coords(x: LabelledArray | Binned, targets: list[str] | str, graph: dict | Graph, *, keep_inputs: bool = True, keep_intermediate: bool = True, keep_aliases: bool = True, rename_dims: bool = True) -> LabelledArray | Binned:
    """Add the target coordinates; of what was used on the way, keep what the options say. Inputs that went into others turn unaligned.

    A dim is renamed when the coordinate of its name goes, through rules of one input each, into a single target.
    """
    if isinstance(x, Binned):
        events = transform_coords(x.events, targets, graph, keep_inputs=keep_inputs, keep_intermediate=keep_intermediate, keep_aliases=keep_aliases, rename_dims=False)
        return replace(x, events=events)
    graph = graph if isinstance(graph, Graph) else Graph(graph)
    targets = [targets] if isinstance(targets, str) else list(targets)
    order = graph.plan(set(x.coords), targets)
    known: dict[str, Quantity] = {n: x.coord(n) for n, c in x.coords.items() if c.edges is None}
    dims = {n: c.dims for n, c in x.coords.items()}
    used: set[str] = set()
    aliases: set[str] = set()
    for out in order:
        if out in known:
            continue
        outputs, rule = graph.rules[out]
        inputs = graph.inputs(rule)
        used |= set(inputs)
        own = tuple(d for d in x.dims if any(d in dims.get(i, ()) for i in inputs))
        if isinstance(rule, str):
            aliases.add(out)
            known[out] = known[rule] if rule in known else _missing(rule)
        else:
            found = rule(**{i: known[i] if i in known else _missing(i) for i in inputs})
            known |= found if isinstance(found, dict) else {out: found}
        for o in outputs:
            dims[o] = own
    made = [n for n in known if n not in x.coords]
    drop = set()
    if not keep_intermediate:
        drop |= {n for n in made if n in used and n not in targets and n not in aliases}
    if not keep_aliases:
        drop |= {n for n in aliases if n not in targets}
    if not keep_inputs:
        drop |= {n for n in x.coords if n in used}
    df = x.df.withColumns({f"c_{n}": known[n].value for n in made if n not in drop}).drop(*(f"c_{n}" for n in drop))
    coords = {n: replace(c, aligned=c.aligned and n not in used) for n, c in x.coords.items() if n not in drop}
    coords |= {n: Coord(dims[n], known[n].unit, known[n].dtype, None, n in targets or n not in used) for n in made if n not in drop}
    out = replace(x, df=df, coords=coords)
    if rename_dims:
        names = {}
        for d in x.dims:
            at, seen = d, set()
            while (after := [o for o in order if at in graph.inputs(graph.rules[o][1])]) and len(after) == 1 and len(graph.inputs(graph.rules[after[0]][1])) == 1 and at not in seen:
                seen.add(at)
                at = after[0]
            if at != d and at in targets:
                names[d] = at
        out = out.rename_dims(**names) if names else out
    return out


def _missing(name: str) -> Quantity:
    raise CoordError(f"{name!r} has bin edges: rules need a coordinate column")


LabelledArray.transform_coords = transform_coords
Binned.transform_coords = transform_coords
