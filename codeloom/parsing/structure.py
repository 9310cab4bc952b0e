"""Structure fingerprints: 64 bits for every node but comments, from node types alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5

from .outline import C, JAVA, Node, parse

ZERO = "0" * 16


@lru_cache(maxsize=65536)
def _leaf(node_type: str) -> str:
    return md5(("0" + md5(node_type.encode()).hexdigest()).encode()).hexdigest()


@lru_cache(maxsize=65536)
def _step(h: str, child: str) -> str:
    return md5((h + child).encode()).hexdigest()


def _fold(root: Node, held: dict[int, tuple[list[str], int, int]]) -> list[str]:
    """fold() of root; held gets where each inner node's own values lie in it."""
    out: list[str] = []
    values: list[str] = []
    stack = [(root, -1, 0)]
    while stack:
        n, at, low = stack.pop()
        if at >= 0:
            h = "0"
            for child in values[low:]:
                h = _step(h, child)
            del values[low:]
            values.append(h)
            out.append(h[:16] if h != "0" else ZERO)
            held[id(n)] = (out, at, len(out))
        elif n.type == "comment":
            continue
        elif n.children:
            stack.append((n, len(out), len(values)))
            stack.extend([(c, -1, 0) for c in reversed(n.children)])
        else:
            h = _leaf(n.type)
            values.append(h)
            out.append(h[:16])
    return out


def fold(node: Node) -> list[str]:
    """Post-order, repeats kept. An inner node folds its children's whole digests; one of comments only counts as 0."""
    return _fold(node, {})


def folds(nodes: Iterable[Node]) -> Iterator[list[str]]:
    """fold() of each of some nodes, which the caller holds; a node inside one that came before is a stretch of that one's values."""
    held: dict[int, tuple[list[str], int, int]] = {}
    for n in nodes:
        if id(n) in held:
            out, a, b = held[id(n)]
            yield out[a:b]
        else:
            yield _fold(n, held)


def structure_fingerprint(code: str | None, language: str | None) -> list[str] | None:
    """Of a whole text, its root included; None for unknown languages."""
    if code is None or language not in (C, JAVA):
        return None
    return fold(parse(code, language)[0])
