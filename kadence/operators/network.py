"""The learned network as plan-time metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Node:
    """One attribute, its parents in cmi_rank order and its domain size."""

    attr_num: int
    name: str
    mi_rank: int
    parents: tuple[str, ...]
    num_values: int


@dataclass(frozen=True)
class Network:
    label: str
    label_num: int
    num_classes: int
    nodes: tuple[Node, ...]

    @property
    def k(self) -> int:
        return max((len(n.parents) for n in self.nodes), default=0)

    @property
    def names(self) -> dict[int, str]:
        return {n.attr_num: n.name for n in self.nodes}

    @classmethod
    def from_structure(cls, structure: DataFrame) -> Network:
        """Read a structure table: at most k rows per attribute, plus the label.

        Key rows (no rank and no parent) of a star structure are skipped.
        """
        label = None
        attrs: dict[int, tuple[str, int, int]] = {}
        parents: dict[int, list[tuple[int, str]]] = {}
        columns = ["attr_num", "attr_name", "parent", "mi_rank", "cmi_rank", "num_values"]
        for row in structure.select(*columns).collect():
            if row.mi_rank is not None:
                attrs[row.attr_num] = (row.attr_name, row.mi_rank, row.num_values)
                if row.cmi_rank is not None:
                    parents.setdefault(row.attr_num, []).append((row.cmi_rank, row.parent))
            elif row.parent is not None:
                label = row
        if label is None:
            raise ValueError("the structure table has no label row")
        nodes = [
            Node(num, name, rank, tuple(p for _, p in sorted(parents.get(num, []))), values)
            for num, (name, rank, values) in attrs.items()
        ]
        return cls(
            label=label.attr_name,
            label_num=label.attr_num,
            num_classes=label.num_values,
            nodes=tuple(sorted(nodes, key=lambda n: n.mi_rank)),
        )
