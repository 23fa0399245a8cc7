"""Containers: datasets of arrays that share coordinates, and groups of anything that operations map over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .array import DimensionError, LabelledArray


class DataGroup(dict):
    """A dict of arrays, frames, groups or plain values; methods of arrays are mapped over the items that have the dims asked for."""

    def apply(self, function: Callable, *args, **kwargs) -> DataGroup:
        return DataGroup({k: function(v, *args, **kwargs) for k, v in self.items()})

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(d for v in self.values() for d in getattr(v, "dims", ())))

    def __getattr__(self, name: str) -> Callable[..., DataGroup]:
        if name.startswith("_") or not any(hasattr(v, name) for v in self.values()):
            raise AttributeError(name)

        def call(*args, **kwargs) -> DataGroup:
            asked = [a for a in (*args, *kwargs.values()) if isinstance(a, str) and a in self.dims]
            takes = lambda v: hasattr(v, name) and (not asked or set(asked) <= set(getattr(v, "dims", ())))
            return DataGroup({k: getattr(v, name)(*args, **kwargs) if takes(v) else v for k, v in self.items()})

        return call

    def _both(self, other: object, operator: str) -> DataGroup:
        if isinstance(other, DataGroup):
            return DataGroup({k: getattr(v, operator)(other[k]) for k, v in self.items() if k in other})
        return DataGroup({k: getattr(v, operator)(other) for k, v in self.items()})

    def __add__(self, other): return self._both(other, "__add__")
    def __sub__(self, other): return self._both(other, "__sub__")
    def __mul__(self, other): return self._both(other, "__mul__")
    def __truediv__(self, other): return self._both(other, "__truediv__")
    def __floordiv__(self, other): return self._both(other, "__floordiv__")
    def __mod__(self, other): return self._both(other, "__mod__")
    def __pow__(self, other): return self._both(other, "__pow__")

    def copy(self) -> DataGroup:
        return DataGroup(self)

    def __getitem__(self, key):
        if isinstance(key, tuple):
            return DataGroup({k: v[key] if key[0] in getattr(v, "dims", ()) else v for k, v in self.items()})
        return super().__getitem__(key)


class Dataset:
    """Named arrays of the same dims; operators work item by item."""

    def __init__(self, items: dict[str, LabelledArray]):
        if len({(x.dims, tuple(x.sizes.items())) for x in items.values()}) > 1:
            raise DimensionError("the items of a dataset have the same dims")
        self.items = dict(items)

    def __getitem__(self, key):
        return self.items[key] if isinstance(key, str) else Dataset({k: v[key] for k, v in self.items.items()})

    def __iter__(self) -> Iterator[str]:
        return iter(self.items)

    def map(self, function: Callable, *args, **kwargs) -> Dataset:
        return Dataset({k: v.map(function, *args, **kwargs) for k, v in self.items.items()})

    def reduce(self, op: str, dim: str | None = None) -> Dataset:
        return Dataset({k: v.reduce(op, dim) for k, v in self.items.items()})

    def _both(self, other: object, operator: str) -> Dataset:
        if isinstance(other, Dataset):
            return Dataset({k: getattr(v, operator)(other.items[k]) for k, v in self.items.items() if k in other.items})
        return Dataset({k: getattr(v, operator)(other) for k, v in self.items.items()})

    def __add__(self, other): return self._both(other, "__add__")
    def __sub__(self, other): return self._both(other, "__sub__")
    def __mul__(self, other): return self._both(other, "__mul__")
    def __truediv__(self, other): return self._both(other, "__truediv__")
    def __floordiv__(self, other): return self._both(other, "__floordiv__")
    def __mod__(self, other): return self._both(other, "__mod__")
    def __pow__(self, other): return self._both(other, "__pow__")

    def __setitem__(self, name: str, item: LabelledArray) -> None:
        self.items = Dataset({**self.items, name: item}).items

    def __delitem__(self, name: str) -> None:
        del self.items[name]

    def __len__(self) -> int:
        return len(self.items)

    def update(self, items: dict[str, LabelledArray]) -> None:
        self.items = Dataset({**self.items, **items}).items

    def pop(self, name: str) -> LabelledArray:
        return self.items.pop(name)

    def clear(self) -> None:
        self.items.clear()


def merge(left: Dataset, right: Dataset) -> Dataset:
    """The items of both; those in both have to be identical."""
    for name in set(left.items) & set(right.items):
        if not left.items[name].identical(right.items[name], equal_nan=True):
            raise ValueError(f"{name!r} differs")
    return Dataset({**left.items, **right.items})
